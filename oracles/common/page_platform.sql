-- uses: page_hosts
select *, case when host = 'example.com' or host like '%.example.com' then 'alpha' when host = 'example.net' or host like '%.example.net' then 'beta' end as platform from page_hosts
