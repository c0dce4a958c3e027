-- uses: finding_rows
select * from finding_rows where rule_id not like 'trap.%'
