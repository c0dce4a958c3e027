-- uses: part_text
select project_id, 'y.test/fork' as name, 'v3.' || v || '.0' as version, true as direct, false as local, '' as path_dep, 5 as line from part_text
union all select project_id, 'z.test/exact', 'v0.' || k || '.0', false, false, '', 6 from part_text
union all select project_id, 'x.test/single', 'v2.0.' || k, true, false, '', 8 from part_text
union all select project_id, 'x.test/loc', 'v1.0.0', true, true, '../loc' || k, 10 from part_text
