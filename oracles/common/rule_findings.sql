-- uses: obligation_hits, trap_hits
select project_id, intent_id, dependency_id, rule_id, severity, confidence, licence from obligation_hits
union all select project_id, intent_id, dependency_id, rule_id, severity, confidence, licence from trap_hits
