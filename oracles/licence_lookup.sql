-- uses: parts, entries
, n(spdx_id, obligations) as (values ('AGPL-3.0-only',4),('Apache-2.0',5),('BSD-3-Clause',3),('CC-BY-NC-4.0',3),('Elastic-2.0',3),('GPL-3.0-only',6),('ISC',1),('LGPL-3.0-only',3),('Llama-3.1-Community',3),('MIT',2),('MPL-2.0',4),('SSPL-1.0',2))
select p_partkey, raw as licence, spdx_id, entry_family as family, cast(obligations as bigint) as obligations from parts left join entries on entry_spdx = spdx left join n on spdx_id = entry_spdx
