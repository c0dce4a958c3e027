-- uses: deps
select project_id, count(*) as dependencies, count(*) filter (kind='weights') as weight_files, count(*) filter (kind='upstream_cli') as upstream_clis from deps group by 1
