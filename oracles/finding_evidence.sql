-- uses: source_hits
select distinct project_id, 'upstream_cli:' || lower(token) as id, rel as path, line from source_hits
