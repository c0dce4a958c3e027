-- uses: files
, segs as (select *, string_split(rel, '/')[:-2] as d from files),
kept as (select * from segs where len(list_intersect(d, ['.git','dist','build','target','out'])) = 0
   and len(list_filter(d, lambda x: x = 'node_modules')) < 2),
venv as (select distinct project_id, regexp_extract(rel, '^(.*)/pyvenv\.cfg$', 1) as v from kept where rel like '%/venv/pyvenv.cfg')
select project_id, rel from kept k where not exists (select 1 from venv where venv.project_id = k.project_id and starts_with(k.rel, v || '/'))
