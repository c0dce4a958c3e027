-- uses: rule_findings, deps
select r.project_id, 'f_' || substr(sha256(dependency_id || chr(0) || rule_id), 1, 12) as item_id, 'the project' as project, rule_id as kind, d.evidence_path as path
from rule_findings r join deps d on d.project_id = r.project_id and d.id = r.dependency_id
