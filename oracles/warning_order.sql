-- uses: files, ignored
, w as (
 select project_id, 'E-SCAN-006' as code, rel as path from files where length > 8388608
 union all select project_id, 'E-SCAN-020', rule_path from (select project_id, rule_path, count(*) as removed, max(n) as n from (select *, count(*) over (partition by project_id) as n from ignored) group by 1, 2) where rule_path is not null and removed * 2 > n)
select project_id, row_number() over (partition by project_id order by code, path) as position, code, path from w
