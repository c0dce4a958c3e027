-- uses: rule_effective
select project_id, count(*) as stops from rule_effective join orders on project_id = 'o' || o_orderkey
where case o_orderstatus when 'O' then band in ('BLOCK','CONDITION') when 'F' then band = 'NOTE' else band = 'BLOCK' end group by 1
