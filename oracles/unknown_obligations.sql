-- uses: obligation_hits
select project_id, dependency_id || '#' || rule_id as id, dep_kind as kind, 'intent_undeclared' as reason, 'scale.mau' as undetermined_field, 'E-POLICY-009' as error_code
from obligation_hits where unknown
