with d as (select 'o' || l_orderkey as project_id, case when l_partkey % 50 = 0 then '' else 'd' || (l_partkey % 9) end as id, ['a/b','/abs','x/../y','','ok'][l_suppkey % 5 + 1] as path from lineitem)
select project_id, subject, problem, count(*) as n from (
 select project_id, id as subject, 'no id' as problem from d where id = ''
 union all select project_id, id, 'no evidence' from d where path = ''
 union all select project_id, id, 'evidence outside the project' from d where path in ('/abs','x/../y')
 union all select project_id, id, 'duplicate id' from d group by 1, 2 having count(*) > 1) group by all
