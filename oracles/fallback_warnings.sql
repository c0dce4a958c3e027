-- uses: unit_rows
select distinct on (project_id, ecosystem) project_id, 'E-PARSE-001' as code, 'app/lock' as path from unit_rows where source = 'manifest'
