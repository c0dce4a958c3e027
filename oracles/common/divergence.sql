-- uses: deps, intents
select w.project_id, i.intent_id, w.id as dependency_id, w.kind as dep_kind, w.spdx as licence, 'trap.code-weights-divergence' as rule_id,
  case when w.entry_family in ('non-commercial','source-available') and use_commercial then 'BLOCK' else 'CONDITION' end as severity,
  case when least(case c.licence_confidence when 'high' then 2 when 'medium' then 1 else 0 end, case w.entry_confidence when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end) = 2 then 'HIGH'
       when least(case c.licence_confidence when 'high' then 2 when 'medium' then 1 else 0 end, case w.entry_confidence when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end) = 1 then 'MEDIUM' else 'LOW' end as confidence,
  'Code is ' || c.entry_spdx || ' but weights are ' || w.entry_spdx as title, c.name as code_name
from (select * from deps where kind = 'weights' and entry_spdx is not null) w
join (select * from deps where kind in ('package','vendored') and entry_spdx is not null
      qualify row_number() over (partition by project_id, scope order by entry_permissiveness desc, kind, name, version, id) = 1) c
  on c.project_id = w.project_id and c.scope = w.scope and c.entry_permissiveness > w.entry_permissiveness
join intents i on i.project_id = w.project_id
