-- uses: files
select project_id, rel, n > 4 as truncated, k > 4 as beyond from (select *, row_number() over (partition by project_id order by rel) as k, count(*) over (partition by project_id) as n from files)
