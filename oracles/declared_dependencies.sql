-- uses: unit_rows
select project_id, ecosystem || ':' || name || '@' || version as id, 'app' as scope, direct, spdx, resolved, source as licence_source,
 case when length(name) % 8 = 0 then '../../out' else '' end as path, case when length(name) % 8 = 0 then 3 else 0 end as entries
from unit_rows where not (length(name) % 4 = 0 and length(name) % 8 <> 0)
