-- uses: files
select project_id, rel, case when starts_with(rel, 'src/') then 'src/**' when regexp_matches(rel, '^docs/a/[^/]*$') then 'docs/a/*' when rel = 'vendor/LICENSE' then 'vendor/LICENSE' end as rule_path from files
