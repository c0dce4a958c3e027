-- uses: rule_findings
select project_id, 'f_' || substr(sha256(dependency_id || chr(0) || rule_id), 1, 12) as finding_id,
 case rule_id when 'agpl-3.0.licence-inclusion' then 'https://www.gnu.org/licenses/agpl-3.0.html' when 'gpl-3.0.convey-verbatim' then 'https://www.gnu.org/licenses/gpl-3.0.html' else 'https://opensource.org/license/' || case rule_id when 'mit.attribution' then 'mit' else 'isc-license-txt' end end as citation_url,
 case when rule_id in ('mit.attribution','isc.permission-notice') then 'Permission notice' else '§4' end as citation_section
from rule_findings where rule_id in ('agpl-3.0.licence-inclusion','gpl-3.0.convey-verbatim','mit.attribution','isc.permission-notice')
