-- uses: all_undetermined
select project_id, row_number() over (partition by project_id order by kind, id) as position, kind, id from all_undetermined
