-- uses: part_text
select project_id, n as name, v || '.0' as version, false as is_range, false as dev from part_text
union all select project_id, 'dev' || k, '*', true, true from part_text
