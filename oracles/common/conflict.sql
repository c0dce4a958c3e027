-- uses: deps, intents
select d.project_id, i.intent_id, id as dependency_id, kind as dep_kind, spdx as licence, 'trap.declared-vs-actual-conflict' as rule_id,
  'CONDITION' as severity, upper(licence_confidence) as confidence,
  'declared MIT, shipped text is ' || entry_spdx as message
from deps d join intents i on i.project_id = d.project_id
where licence_source = 'vendored_file' and entry_spdx is not null and lower(spdx) <> 'mit' and entry_permissiveness < 5
