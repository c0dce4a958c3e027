with p as (select p_partkey, p_partkey % 8 as k, replace(p_name,' ','-') as n from part)
select p_partkey, case k when 0 then 'LICENSE' when 1 then 'Licence-' || n when 2 then n || '.md' when 3 then 'license.' when 4 then 'COPYING.' || n when 5 then 'NOTICE' when 6 then 'my-license-' || n else 'copying-x' end as base,
 k in (0,1,4,5) as is_licence, case k when 0 then 'license' when 1 then 'licence-' || n when 2 then n when 3 then 'license' when 4 then 'copying' when 5 then 'notice' when 6 then 'my-license-' || n else 'copying-x' end as stem from p
