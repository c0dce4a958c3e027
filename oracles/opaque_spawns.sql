-- uses: part_text
select project_id, 'E-SCAN-021' as code, 'cmd/main.go' as path, 6 as line from part_text union all select project_id, 'E-SCAN-021', 'a/run.py', 5 from part_text
