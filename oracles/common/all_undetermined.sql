-- uses: obligation_hits, unresolved
select project_id, intent_id, dependency_id as id, dep_kind as kind, reason from unresolved
union all select project_id, intent_id, dependency_id || '#' || rule_id, dep_kind, 'intent_undeclared' from obligation_hits where unknown
