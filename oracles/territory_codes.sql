with c as (select c_custkey, c_custkey % 7 as k, c_mktsegment as m from customer)
select c_custkey, case k when 0 then substr(m,1,2) when 1 then 'global' when 2 then 'EEA' when 3 then lower(substr(m,1,2)) when 4 then m when 5 then ' US ' else '' end as code, k in (0,1,2,5) as valid from c
