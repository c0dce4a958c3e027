-- uses: page_platform
select project_id, 'upstream_cli:' || page_id as id, host as token, platform from page_platform
