-- uses: obligation_hits, trap_hits, divergence, conflict
select project_id, intent_id, dependency_id, dep_kind, licence, rule_id, severity, confidence from obligation_hits
union all select project_id, intent_id, dependency_id, dep_kind, licence, rule_id, severity, confidence from trap_hits
union all select project_id, intent_id, dependency_id, dep_kind, licence, rule_id, severity, confidence from divergence
union all select project_id, intent_id, dependency_id, dep_kind, licence, rule_id, severity, confidence from conflict
