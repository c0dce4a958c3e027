-- uses: parts
select * from (select 'p' || p_partkey as project_id, case when p_partkey % 3 <> 0 and raw <> '' then raw when p_partkey % 2 = 0 then 'MIT' end as own_licence from parts) where own_licence is not null
