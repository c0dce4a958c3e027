-- uses: ignored
select project_id, rule_path, count(*) as removed, max(n) as files, floor(count(*) * 100 / max(n))::bigint as percent
from (select *, count(*) over (partition by project_id) as n from ignored) where rule_path is not null group by 1, 2 having count(*) * 2 > max(n)
