-- uses: trap_hits, deps
select project_id, intent_id, dependency_id, rule_id, severity, confidence,
  case when confidence = 'MEDIUM' and severity = 'BLOCK' then 'CONDITION' else severity end as effective_severity,
  'f_' || substr(sha256(dependency_id || chr(0) || rule_id), 1, 12) as finding_id,
  case when t.licence <> '' then t.licence when raw <> '' then raw else 'no licence declared' end as licence
from trap_hits t join (select project_id, id as dependency_id, raw from deps) using (project_id, dependency_id)
