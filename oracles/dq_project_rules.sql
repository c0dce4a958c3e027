with o as (select 'o' || o_orderkey as p, o_orderkey % 7 as i, (o_orderkey // 7) % 3 as r, (o_orderkey // 3) % 7 as w from orders),
x as (
 select p || ':' || ['src/**', '**', 'app/yarn.lock', '.', './**', 'docs\go.sum', 'go.sum/*'][i + 1] as subject,
  unnest([case when r <> 0 then 'no reason' end, case when i in (3, 4) then 'hides everything' end, case when i in (2, 5, 6) then 'hides a lockfile' end]) as problem from o
 union all select p || ':' || ['MIT', '*', 'GPL-*', 'all', ' Any ', 'LGPL-2.1', ''][w + 1], case when w in (1, 2, 3, 4, 6) then 'waives everything' end from o)
select subject, problem from x where problem is not null
