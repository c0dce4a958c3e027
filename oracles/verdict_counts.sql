-- uses: intents, rule_effective, all_undetermined
, f as (select project_id, count(*) filter (band='BLOCK') b, count(*) filter (band='CONDITION') c, count(*) filter (band='NOTE') n from rule_effective group by 1)
, u as (select project_id, count(*) k from all_undetermined group by 1)
select i.project_id, case when coalesce(b,0) > 0 then 'DO_NOT_SHIP' when coalesce(k,0) > 0 then 'UNDETERMINED' when coalesce(c,0) > 0 then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict,
 coalesce(b,0) as blockers, coalesce(c,0) as conditions, coalesce(n,0) as notes, coalesce(k,0) as undetermined
from intents i left join f using (project_id) left join u using (project_id)
