select 'o' || o_orderkey as project_id, case o_orderkey % 4 when 0 then 'n' || o_orderkey else 'cfg' || o_orderkey end as project_name,
 case o_orderkey % 4 when 0 then true end as use_commercial, case o_orderkey % 4 when 0 then 'dual' end as use_licence_model, case o_orderkey % 4 when 1 then false end as use_saas,
 case o_orderkey % 4 when 0 then o_custkey end as scale_mau, null::bigint as scale_employees, case o_orderkey % 4 when 0 then 'EU,us' else '' end as territories,
 case o_orderkey % 4 when 0 then 'GPL-3' end as never_allow, case o_orderkey % 4 when 0 then 'NOTE' end as block_on, case o_orderkey % 4 when 0 then 1 end as ignores from orders
