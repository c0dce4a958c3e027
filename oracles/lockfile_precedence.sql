-- uses: unit_rows
select project_id, ecosystem, name, version, source, direct from unit_rows
