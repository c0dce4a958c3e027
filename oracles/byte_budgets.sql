-- uses: files
select project_id, rel, sum(length) over (partition by project_id order by rel rows unbounded preceding) > 9000000 as over_budget from files
