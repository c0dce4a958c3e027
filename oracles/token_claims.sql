with t as (select distinct p_type as signal, lower(p_name) as token, p_brand as platform from part),
n as (select *, count(*) over (partition by signal, token) as platforms, row_number() over (partition by signal, token order by platform) as pos from t)
select signal, token, platforms, (pos - 1) // 4 as page, string_agg(platform, ',' order by platform) as claimants from n where platforms > 1 group by 1, 2, 3, 4
