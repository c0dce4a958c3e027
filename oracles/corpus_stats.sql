with t as (
 select 'licences' as what, p_type as part, p_brand as key from part
 union all select 'traps', l_returnflag, l_partkey::varchar from lineitem
 union all select 'platforms', s_nationkey::varchar, s_suppkey::varchar from supplier
 union all select 'territories', n_regionkey::varchar, n_name from nation
 union all select 'citations', coalesce(source, ''), lang from documents)
select what, coalesce(part, '') as part, count(*) as entries, count(distinct key) as keys from t group by 1, 2
union all select what, null, count(*), count(distinct key) from t group by 1
union all select null, null, count(*), count(distinct (what, key)) filter (key is not null) from t
