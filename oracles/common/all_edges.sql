-- uses: parts, entries
select 'o' || l_orderkey as project_id, ecosystem || ':' || name || '@' || version as id, kind, name, version, ecosystem, spdx, raw, resolved, entry_spdx, entry_family
from lineitem join parts on parts.p_partkey = l_partkey left join entries on upper(entry_spdx) = upper(spdx)
