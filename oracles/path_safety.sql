with p as (select p_partkey, p_partkey % 8 as k, replace(p_name,' ','/') as n from part),
s as (select *, case k when 0 then n when 1 then '/' || n when 2 then './' || n when 3 then '../' || n when 4 then 'C:' || n when 5 then 'a\' || n when 6 then n || '#x' else '  ' end as path from p)
select p_partkey, path, k in (0,2,5,6) as safe, case k when 0 then n when 2 then n when 4 then path when 5 then 'a/' || n else '' end as uri, case when k in (0,2,5,6) then 2 else 1 end as kept from s
