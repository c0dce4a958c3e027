-- uses: file_parts
, own as (select * from file_parts where not in_tree),
m as (select project_id, dir, case base when 'package.json' then 'npm' else 'pypi' end as e, rel, modification_time from own where base in ('package.json','pyproject.toml')
   union all select project_id, dir, 'pypi', rel, modification_time from own o where base = 'requirements.txt' and not exists (select 1 from own p where p.project_id = o.project_id and p.dir = o.dir and p.base = 'pyproject.toml')),
l as (select project_id, dir, case base when 'package-lock.json' then 'npm' else 'pypi' end as e, rel, modification_time from own where base in ('package-lock.json','poetry.lock'))
select m.project_id, m.rel as manifest, l.rel as lockfile, 'E-SCAN-015' as code from m join l using (project_id, dir, e) where m.modification_time - l.modification_time > interval 60 second
