with s as (select s_suppkey as k, case when s_suppkey % 10 = 0 then ' ' else 'p' || s_suppkey end as slug from supplier),
p as (
 select slug as subject, unnest([case when k % 10 = 0 then 'no slug' end, case when k % 3 = 2 then 'kind' end, case when k % 2 = 1 then 'last verified' end, case when k % 5 = 0 then 'staleness window' end]) as problem from s
 union all select slug, unnest([case when k % 3 = 1 then 'blank token' end, case when k % 2 = 1 then 'signal' end]) from s
 union all select 'c' || k, unnest([case when k % 2 = 1 then 'severity' end, case when k % 3 = 2 then 'confidence' end, case when k % 2 = 1 then 'summary' end, case when k % 2 = 1 then 'citation' end]) from s)
select subject, problem, count(*) as n from p where problem is not null group by 1, 2
