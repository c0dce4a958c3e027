-- uses: effective
select project_id, intent_id, dependency_id, rule_id, severity, confidence, effective_severity,
  'f_' || substr(sha256(dependency_id || chr(0) || rule_id), 1, 12) as finding_id, licence from effective
