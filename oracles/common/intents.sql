select 'o' || o_orderkey as project_id, 'declared' as intent_id, 'order-' || o_orderkey as project_name,
  o_orderpriority in ('1-URGENT','2-HIGH') as use_commercial,
  case c_mktsegment when 'FURNITURE' then 'closed-source' when 'MACHINERY' then 'open-source' when 'BUILDING' then 'source-available'
                    when 'AUTOMOBILE' then 'dual' else 'internal-only' end as use_licence_model,
  o_orderstatus = 'F' as use_modified,
  o_orderpriority in ('1-URGENT','3-MEDIUM') as use_network_exposed,
  o_orderstatus in ('O','F') as use_distributed,
  c_mktsegment = 'MACHINERY' as use_saas,
  case when o_orderstatus <> 'P' then o_custkey * 1000000 end as scale_mau,
  case when o_orderpriority <> '5-LOW' then o_custkey % 5000 end as scale_employees,
  case when o_orderpriority <> '4-NOT SPECIFIED' then cast(floor(o_totalprice) as bigint) end as scale_revenue_eur,
  case r_name when 'EUROPE' then ['EU','GB'] when 'AMERICA' then ['US'] when 'ASIA' then ['cn','US'] when 'AFRICA' then ['global']
              else []::varchar[] end as territories
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
