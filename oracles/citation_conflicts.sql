-- uses: part_citations
select url, section, arg_min(owner, p_partkey) as owner, arg_min({'e': excerpt}, p_partkey).e as excerpt, count(distinct coalesce(excerpt,'')) > 1 as conflict, count(*) as uses from part_citations group by 1, 2
