-- uses: deps
select project_id, k as ordinal, id, 'SPDXRef-Package-' || lpad(k::varchar, 4, '0') || '-' || substr(sha256(id), 1, 6) as spdx_id
from (select project_id, id, row_number() over (partition by project_id order by kind, name, version, id) as k from deps)
