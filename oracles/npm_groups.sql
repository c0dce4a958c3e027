-- uses: part_text
select project_id, '@s/' || n as name, v || '.0.0' as version, true as is_range, false as dev, false as optional from part_text
union all select project_id, 'odd', '', false, false, false from part_text
union all select project_id, 'd' || k, v || '.2', false, true, false from part_text
union all select project_id, 'p', '1 <2', true, false, false from part_text
union all select project_id, 'o' || k, 'latest', true, false, true from part_text
