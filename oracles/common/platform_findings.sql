-- uses: page_platform
select project_id, intent_id, dependency_id, rule_id, licence, severity, confidence,
  case when confidence = 'HIGH' then severity when confidence = 'MEDIUM' and severity = 'BLOCK' then 'CONDITION' when confidence = 'LOW' and severity in ('BLOCK','CONDITION') then 'NOTE' else severity end as effective_severity
from (select project_id, platform, min('upstream_cli:' || page_id) as dependency_id from page_platform where platform is not null group by 1, 2) p
join (values ('alpha','paid','alpha.resale','BLOCK','HIGH'), ('alpha','free','alpha.scale','CONDITION','MEDIUM'), ('alpha','paid','alpha.note','NOTE','LOW'), ('alpha','free','alpha.note','NOTE','LOW'),
  ('beta','paid','beta.terms','BLOCK','MEDIUM'), ('beta','free','beta.terms','BLOCK','MEDIUM'), ('beta','free','beta.private','CONDITION','LOW')) c(platform, intent_id, rule_id, severity, confidence) using (platform)
cross join (select 'platform ToS' as licence)
