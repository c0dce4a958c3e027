with p as (select p_partkey, p_partkey % 8 as k, p_size::varchar as v from part)
select p_partkey, case k when 0 then '^' || v || '.1' when 1 then '~' || v when 2 then '>=' || v || ', <9' when 3 then '==' || v || '.0' when 4 then v || '.x' when 5 then ' = ' || v || ' ' when 6 then v || ' || 3' else '!=' || v end as raw,
 k <> 4 as is_range, case k when 0 then v || '.1' when 1 then v when 2 then v when 3 then v || '.0' when 4 then v || '.x' when 5 then v when 6 then v || ' || 3' else v end as version from p
