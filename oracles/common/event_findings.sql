select ts, user_id::varchar as project_id, event_type || ':' || (event_id % 200) as finding_id, event_type = 'signup' and value > 100 as undecided,
 case when event_type = 'error' and value > 60 then 'BLOCK' when (event_type = 'error' and value > 10) or (event_type = 'purchase' and value > 10) then 'CONDITION' else 'NOTE' end as band from events
