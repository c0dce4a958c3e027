-- uses: part_citations
select p_type as family, count(*) as entries, cast(sum(p_size) as bigint) as obligations, count(distinct (url, section)) as citations from part_citations group by 1
