-- uses: sarif_rows
select project_id, item_id, rule_id, level, uri, start_line from sarif_rows
