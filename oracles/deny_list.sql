-- uses: deps
select d.project_id, id as dependency_id, spdx as licence, 'BLOCK' as severity, 'HIGH' as confidence
from deps d join orders on d.project_id = 'o' || o_orderkey
where (o_orderpriority='1-URGENT' and spdx='AGPL-3.0-only') or (o_orderpriority='2-HIGH' and spdx='CC-BY-NC-4.0') or (o_orderpriority='5-LOW' and spdx='GPL-3.0-only')
