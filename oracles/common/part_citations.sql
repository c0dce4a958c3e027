select p_partkey, 'p' || p_partkey as owner, 'https://x.test/' || p_brand as url, 's' || (p_size % 7) as section, case when p_size % 7 <> 0 then case when p_size % 2 = 0 then p_brand else p_type end end as excerpt, p_type, p_size from part
