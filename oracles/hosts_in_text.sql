with t as (
 select page_id, 'see ' || replace(url, 'example', 'sample') || ' or http://Docs.' || regexp_extract(replace(url, 'example', 'sample'), '//([^/]+)', 1)
  || '/x, not https://localhost.test/ ' || html || ' https://end.p' || page_id || '.io' as text from pages
), h as (
 select page_id, lower(unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9][A-Za-z0-9._-]*\.[A-Za-z]{2,})', 1))) as host from t
), kept as (
 select distinct page_id, host from h
 where host not in ('localhost', '127.0.0.1', '0.0.0.0', '::1', 'example.com', 'example.org', 'example.net', 'test.invalid', 'invalid')
  and not regexp_matches(host, '(\.invalid|\.local|\.test|\.example)$')
)
select page_id, coalesce(string_agg(host, ',' order by host), '') as hosts from t left join kept using (page_id) group by page_id
