-- uses: part_text
select project_id, 'top' || k as name, v || '.0.0' as version, false as is_range, true as direct, '' as licence_raw, false as optional from part_text
union all select project_id, 'mid', '^1', true, false, '', true from part_text
union all select project_id, 'leaf' || k, '3', false, false, 'MIT', false from part_text
