-- uses: parts, entries
select 'o' || l_orderkey as project_id, ecosystem || ':' || name || '@' || version as id, kind, name, version, ecosystem,
  's' || l_suppkey as scope, l_linenumber <= 3 as direct, spdx, raw, licence_source, expression, resolved, licence_confidence,
  declared_licence, 'lines/' || l_suppkey || '.txt' as evidence_path, l_linenumber as evidence_line,
  entry_spdx, entry_family, entry_permissiveness, entry_confidence
from (select * from lineitem qualify row_number() over (
        partition by l_orderkey, l_partkey order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_shipdate desc) = 1) li
join parts on parts.p_partkey = l_partkey
left join entries on upper(entry_spdx) = upper(spdx)
