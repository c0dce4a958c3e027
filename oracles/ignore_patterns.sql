-- uses: files
select * from (select project_id, rel, case
 when regexp_matches(rel, '(^|/)node_modules/.') then '**/node_modules/**'
 when regexp_matches(rel, '^src/(.*/)?LICENSE$') then 'src/**/LICENSE'
 when regexp_matches(rel, '^docs/[^/]+/p[^/]/[^/]*[.]json$') then 'docs/*/p?/*.json'
 when regexp_matches(rel, '[.]lock$') then '**/*.lock'
 when rel like 'app/dist/%' then 'app/dist/**' end as rule_path from files) where rule_path is not null
