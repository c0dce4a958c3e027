select project_id, rel, max(length) as length, max(modification_time) as modification_time from (
 select 'o' || l_orderkey as project_id, concat_ws('/', ['src','vendor','node_modules','.git','docs/a','app/dist','lib/venv'][l_linenumber % 7 + 1],
   case when l_partkey % 3 = 0 then 'p' || (l_partkey % 2) end, case when l_partkey % 5 = 0 then '@acme/lib' || (l_suppkey % 2) end,
   case when l_partkey % 7 = 0 then 'node_modules' end, case when l_partkey % 11 = 0 then 'x' || l_partkey end,
   ['LICENSE','package.json','package-lock.json','Cargo.toml','README.md','pyvenv.cfg','go.mod','requirements.txt','poetry.lock','yarn.lock','pyproject.toml'][(l_suppkey + l_linenumber) % 11 + 1]) as rel,
   l_partkey * 5000 as length, l_shipdate as modification_time
 from (select * from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_shipdate desc) = 1)) group by 1, 2
