-- uses: part_text
select project_id, 'pkg' || k as name, v || '.0' as version, true as dev from part_text
union all select project_id, n, '1.0', false from part_text
