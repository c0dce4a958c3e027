-- uses: parts
, t as (select *, case ecosystem when 'npm' then 'npm' when 'pypi' then 'pypi' when 'go' then 'golang' when 'cargo' then 'cargo' end as k from parts)
select p_partkey, coalesce('pkg:' || k || '/' || name || '@' || version, '') as purl, coalesce('pkg:' || k || '/' || name || '%20%23%3F%5Bx%5D%25', '') as odd_purl from t
