-- uses: deps, rule_effective, unresolved
, f as (select project_id, dependency_id as id, max(case band when 'BLOCK' then 3 when 'CONDITION' then 2 else 1 end) as w, count(*) as n from rule_effective group by 1, 2)
, e as (select *, case ecosystem when 'npm' then 'npm' when 'pypi' then 'pypi' when 'go' then 'golang' when 'cargo' then 'cargo' end as k from deps)
select e.project_id, e.id, case kind when 'weights' then 'machine-learning-model' else 'library' end as type, coalesce('pkg:' || k || '/' || name || '@' || version, '') as purl,
 case when spdx <> '' then spdx end as licence, coalesce(declared_licence, nullif(spdx,''), 'NOASSERTION') as declared, coalesce(nullif(spdx,''), 'NOASSERTION') as concluded,
 case w when 3 then 'BLOCK' when 2 then 'CONDITION' when 1 then 'NOTE' end as component_severity, u.reason as undetermined, cast(coalesce(n, 0) as integer) as findings
from e left join f on f.project_id = e.project_id and f.id = e.id left join unresolved u on u.project_id = e.project_id and u.dependency_id = e.id
