select 'p' || p_partkey as project_id, replace(p_name,' ','-') as n, p_partkey as k, p_size as v from part
