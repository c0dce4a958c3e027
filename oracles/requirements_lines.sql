-- uses: part_text
select project_id, n as name, v || '.1' as version, true as is_range, 2 as line from part_text
union all select project_id, 'lib-' || k, v::varchar, true, 4 from part_text
union all select project_id, 'plain' || k, '', false, 6 from part_text
union all select project_id, 'tilde' || k, '2.' || v, true, 9 from part_text
union all select project_id, 'any' || k, '*', true, 10 from part_text
