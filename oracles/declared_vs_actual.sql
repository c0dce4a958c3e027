-- uses: conflict
select project_id, dependency_id, severity, confidence, message from conflict
