with recursive leaf as (
 select place, sha256('leaf:' || place || ':' || case when text is null then '-' else sha256(text) end) as digest
 from (select sha256(doc_id::varchar) as place, text from documents)),
d as (select greatest(1, ceil(log(greatest(count(*), 2)) / log(16)))::int as depth from leaf),
node as (
 select depth as level, substr(place, 1, depth) as prefix, sha256('node:' || string_agg(digest, '' order by place, digest)) as digest from leaf, d group by all
 union all
 select level - 1, substr(prefix, 1, level - 1), sha256('node:' || string_agg(digest, '' order by prefix)) from node where level > 0 group by 1, 2)
select level, prefix, digest from node
