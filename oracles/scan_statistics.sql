-- uses: files
, f as (select *, len(string_split(rel,'/')) - 1 as dirs from files)
select project_id, count(*) as files_seen, cast(sum(length) as bigint) as bytes_seen, cast(max(dirs) as integer) as max_depth, count(*) filter (length > 4000000) as over_limit, count(*) filter (dirs > 4) as too_deep from f group by 1
