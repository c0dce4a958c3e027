-- uses: part_text
select project_id, n as name, v::varchar as version, true as is_range, false as dev from part_text
union all select project_id, 'extra' || k, '1.0', true, false from part_text
union all select project_id, 'poem' || k, v || '.1', true, false from part_text
union all select project_id, 'tbl', '2.*', true, false from part_text
union all select project_id, 'qa', v || '.0', false, true from part_text
