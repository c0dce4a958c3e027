-- uses: file_parts
, t as (select project_id, rel, case when length(rel) % 4 <> 0 then case when length(rel) % 3 = 0 then 'MIT' else 'GPL-3.0-only' end end as spdx,
  case when contains(rel,'node_modules/') then substr(rel, instr(rel,'node_modules/') + 13) else substr(rel, instr(rel,'vendor/') + 7) end as rest from file_parts where in_tree and base = 'LICENSE'),
o as (select *, case when starts_with(rest,'p0/') then 'p0' when starts_with(rest,'p1/') then 'p1' when starts_with(rest,'@acme/') then '@acme' end as owner from t where spdx is not null),
first as (select project_id, owner, arg_min(spdx, rel) as spdx, min(rel) as rel from o where owner is not null group by 1, 2),
d as (select distinct project_id, unnest(['p0','p1','@acme']) as name from t)
select d.project_id, 'npm:' || name as id, 'package' as kind, name, case when name = 'p1' then 'Apache-2.0' else coalesce(f.spdx, '') end as spdx,
  case when name <> 'p1' and f.spdx is not null then 'vendored_file' else 'manifest' end as licence_source, name = 'p1' or f.spdx is not null as resolved, null as declared_licence
from d left join first f on f.project_id = d.project_id and f.owner = d.name
union all
select o.project_id, 'vendored:' || o.rel, 'vendored', coalesce(o.owner, regexp_extract(o.rel, '^(.*)/[^/]*$', 1)), o.spdx, 'vendored_file', true,
  case when o.owner = 'p1' then 'Apache-2.0' when o.owner is not null then f.spdx end
from o left join first f on f.project_id = o.project_id and f.owner = o.owner where o.owner is null or o.owner = 'p1' or o.rel <> f.rel
