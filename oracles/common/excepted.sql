-- uses: rule_findings, exceptions
select f.*, e.owner, case when f.org = 'b' then case e.expires when '2026-12-31' then '2026-01-31' when '2026-01-31' then '2026-12-31' else e.expires end else e.expires end as expires
from (select *, case when substr(project_id, 2)::bigint % 2 = 0 then 'a' else 'b' end as org from rule_findings) f
left join exceptions e on e.dependency = f.dependency_id and (e.kind is null or e.kind = f.rule_id)
qualify row_number() over (partition by project_id, intent_id, dependency_id, rule_id order by ordinal) = 1
