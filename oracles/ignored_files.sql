-- uses: ignored
select * from ignored where rule_path is not null
