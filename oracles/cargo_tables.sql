-- uses: part_text
select project_id, n as name, v || '.0' as version, true as is_range, false as dev, false as optional, false as local, '' as path_dep from part_text
union all select project_id, 'loc', '', false, false, false, true, '../loc' || k from part_text
union all select project_id, 't' || k, '1.2', true, true, true, false, '' from part_text
union all select project_id, 'deep', '3', true, false, false, false, '' from part_text
