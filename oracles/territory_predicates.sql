-- uses: intents
, t as (select project_id, case when len(territories)=0 then null else territories[1] end as a from intents)
select project_id, x.p as predicate, coalesce(x.t, 'UNKNOWN') as truth, case when x.t is null then 'territories' end as field from (
select project_id, unnest([
 {'p':'eq_us','t':case a when 'US' then 'TRUE' when 'EU' then 'FALSE' when 'cn' then 'FALSE' when 'global' then 'FALSE' end},
 {'p':'ne_us','t':case a when 'US' then 'FALSE' when 'EU' then 'TRUE' when 'cn' then 'TRUE' when 'global' then 'TRUE' end},
 {'p':'in_eu_gb','t':case a when 'US' then 'FALSE' when 'EU' then 'TRUE' when 'cn' then 'FALSE' when 'global' then 'FALSE' end},
 {'p':'in_us_cn','t':case a when 'US' then 'TRUE' when 'EU' then 'FALSE' when 'cn' then 'TRUE' when 'global' then 'FALSE' end},
 {'p':'has_cn','t':case a when 'US' then 'FALSE' when 'EU' then 'FALSE' when 'cn' then 'TRUE' when 'global' then 'TRUE' end},
 {'p':'has_eu','t':case a when 'US' then 'FALSE' when 'EU' then 'TRUE' when 'cn' then 'FALSE' when 'global' then 'TRUE' end}]) as x from t)
