-- uses: part_text
select project_id, n as name, v || '.0.0' as version, true as direct, 'MIT' as licence_raw, false as dev from part_text
union all select project_id, '@s/b' || k, '2', false, 'ISC', true from part_text
