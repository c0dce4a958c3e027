-- uses: event_findings
select date_trunc('day', ts)::timestamp as window_start, project_id, case when bool_or(band='BLOCK') then 'DO_NOT_SHIP' when bool_or(undecided) then 'UNDETERMINED' when bool_or(band='CONDITION') then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict, count(*) as findings
from event_findings group by 1, 2
