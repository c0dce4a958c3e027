-- uses: eval_rows
select project_id, intent_id, id as dependency_id, rule_id, severity, confidence, severity as effective_severity,
  'f_' || substr(sha256(id || chr(0) || rule_id), 1, 12) as finding_id, spdx as licence
from (select *, 'own.mit.large' as rule_id, 'CONDITION' as severity, 'HIGH' as confidence from eval_rows where scale_employees >= 1000
      union all
      select *, 'own.mit.not-europe', 'NOTE', 'LOW' from eval_rows where len(territories) > 0 and territories <> ['EU','GB'])
where entry_spdx = 'MIT'
