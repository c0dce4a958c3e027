-- uses: intents, effective, all_undetermined
select project_id, intent_id,
  case when blockers > 0 then 'DO_NOT_SHIP' when undetermined > 0 then 'UNDETERMINED' when conditions > 0 then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict,
  blockers, conditions, notes, undetermined
from (select i.project_id, i.intent_id, coalesce(blockers,0) blockers, coalesce(conditions,0) conditions, coalesce(notes,0) notes, coalesce(undetermined,0) undetermined
 from intents i
 left join (select project_id, intent_id, count(*) filter (effective_severity='BLOCK') blockers, count(*) filter (effective_severity='CONDITION') conditions,
              count(*) filter (effective_severity in ('NOTE','INFO')) notes from effective group by 1,2) f using (project_id, intent_id)
 left join (select project_id, intent_id, count(*) undetermined from all_undetermined group by 1,2) u using (project_id, intent_id))
