-- uses: sarif_rows
select project_id, '2.1.0' as version, count(*) as results, count(*) as indexed, count(distinct rule_id)::int as rules, sum(('0x' || substr(md5(concat_ws('|', rule_id, level, uri, start_line)), 1, 8))::bigint)::bigint as said from sarif_rows group by 1
