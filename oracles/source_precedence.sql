with w as (select distinct 's' || l_suppkey as project_id, 'm' || (l_orderkey % 50) as dir, 'm' || (l_orderkey % 50) || '/w' || l_partkey || '.gguf' as rel from lineitem where l_linenumber <= 3),
s as (select distinct 's' || l_suppkey as project_id, case when l_linenumber = 7 then '.' else 'm' || (l_orderkey % 50) end as dir, l_partkey % 6 as rank, 'f' || l_partkey as base from lineitem where l_linenumber > 3),
h as (select w.project_id, w.rel, s.rank, 'L-' || base as spdx, row_number() over (partition by w.project_id, w.rel order by s.rank, case when s.rank < 5 and s.dir = '.' then 1 else 0 end, case when s.dir = '.' then base else s.dir || '/' || base end) as k
 from w join s on s.project_id = w.project_id and s.dir in (w.dir, '.'))
select w.project_id, w.rel, cast(h.rank as integer) as rank, h.spdx from w left join h on h.project_id = w.project_id and h.rel = w.rel and k = 1
