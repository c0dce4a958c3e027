-- uses: parts
select p_partkey, case when p_partkey % 5 in (0,1,2) then raw else '' end as raw from parts
