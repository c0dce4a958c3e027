-- uses: excepted
select project_id, dependency_id, rule_id, severity as corpus_severity, case when expires >= '2026-09-23' then 'NOTE' else severity end as severity,
  case when expires >= '2026-09-23' then 'excepted' else 'expired' end as policy_decision, owner as exception_owner, expires as exception_expires
from excepted where owner is not null
