select p_partkey, case when p_partkey % 5 in (0,3) then replace(p_name,' ','_') end as key from part
