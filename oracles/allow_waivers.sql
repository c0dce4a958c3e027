-- uses: rule_findings
select r.project_id, dependency_id, rule_id, 'NOTE' as severity, 'NOTE' as effective_severity from rule_findings r join orders on r.project_id = 'o' || o_orderkey
where licence = case o_orderstatus when 'O' then 'MIT' when 'F' then 'GPL-3.0-only' else 'BSD-3-Clause' end
 and (o_orderstatus <> 'F' or (o_orderpriority <> '5-LOW' and o_custkey % 5000 > 70))
