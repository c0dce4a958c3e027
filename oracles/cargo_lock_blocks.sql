-- uses: part_text
select project_id, 'app' || k as name, '0.1.0' as version, false as direct, true as local, 4 as line from part_text
union all select project_id, 'serde', '1.' || v, true, false, 12 from part_text
union all select project_id, n, v || '.0.0', true, false, 18 from part_text
union all select project_id, 'deep' || k, '2.0.0', false, false, 23 from part_text
