-- uses: file_parts
, n(base, ecosystem, role, r) as (values ('package.json','npm','m',0),('package-lock.json','npm','l',0),('yarn.lock','npm','u',1),('pyproject.toml','pypi','m',0),('requirements.txt','pypi','m',1),('poetry.lock','pypi','l',0),('go.mod','go','m',0),('Cargo.toml','cargo','m',0))
select project_id, dir, ecosystem, arg_min(rel, r) filter (role='m') as manifest, arg_min(rel, r) filter (role='l') as lockfile, coalesce(string_agg(rel, ',' order by rel) filter (role='u'), '') as unsupported
from file_parts join n using (base) where not in_tree group by 1, 2, 3
