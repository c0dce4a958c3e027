-- uses: divergence
select project_id, dependency_id, severity, confidence, title from divergence
