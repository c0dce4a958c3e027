-- uses: page_platform
select project_id, platform, min('upstream_cli:' || page_id) as primary_id, count(*) as contributors, count(distinct page_id) as places from page_platform where platform is not null group by 1, 2
