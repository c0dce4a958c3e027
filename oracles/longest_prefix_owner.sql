-- uses: file_parts
, units as (select distinct project_id, dir from file_parts where not in_tree and base in ('package.json','package-lock.json','yarn.lock','pyproject.toml','requirements.txt','poetry.lock','go.mod','Cargo.toml')),
f as (select project_id, rel, case when contains(rel,'node_modules/') then substr(rel, instr(rel,'node_modules/') + 13) else substr(rel, instr(rel,'vendor/') + 7) end as rest from file_parts where in_tree),
s as (select f.*, coalesce((select arg_max(dir, length(dir)) from units u where u.project_id = f.project_id and starts_with(f.rel, u.dir || '/')), '.') as scope from f),
p(name, pscope) as (values ('p0','.'),('p0/@acme/lib0','.'),('@acme/lib1','lib/venv'),('@acme','.'),('node_modules','.'),('p1','src'))
select project_id, rel, any_value(scope) as scope, arg_min('npm:' || name, [case when pscope = scope then 0 else 1 end, -length(name)]) as owner_id
from s left join p on rest = name or starts_with(rest, name || '/') group by 1, 2
