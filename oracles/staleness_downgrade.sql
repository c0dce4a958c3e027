with l as (select l_suppkey % 400 as w, case when l_suppkey % 400 = 7 then 'last spring' when l_suppkey % 400 = 8 then '' else strftime(l_shipdate, '%Y-%m-%d') end as retrieved_at from lineitem),
a as (select *, date_diff('day', try_cast(retrieved_at as date), date '2000-06-30') as age from l)
select retrieved_at, case when retrieved_at = '' then false when age is null then true else age > 180 end as citation_stale, count(*) as n, count(*) filter (coalesce(age > w, false)) as platform_stale_n
from a group by 1, 2
