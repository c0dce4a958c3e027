with c as (select l_orderkey, case when l_partkey % 3 = 0 then l_linenumber % 6 else l_linenumber % 3 end as k from lineitem)
select l_orderkey, arg_min(['real','derived','estimated','simulated','unknown','odd'][k + 1], [4,3,2,1,0,0][k + 1] * 10 + case k when 5 then 0 else 1 end) as provenance from c group by 1
