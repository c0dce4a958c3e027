-- uses: licence_problems, licence_entries
, names as (select unnest(['no identifier', 'unknown family', 'permissiveness', 'confidence', 'citation', 'last verified', 'correction', 'alias as identifier']) as name)
select n.name as check, (select count(*) from licence_problems p where p.problem = n.name) as failures, (select count(*) from part) as rows, (select count(*) from part) as written from names n
union all select 'bad', (select count(distinct subject) from licence_problems where problem is not null), (select count(*) from part), (select count(*) from part)
