select page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) as project_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host from pages
