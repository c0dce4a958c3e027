-- uses: effective, obligation_hits
, u as (select rule_id, count(*) as k from obligation_hits where unknown group by 1)
select rule_id, effective_severity, count(*) as n, case when effective_severity = 'NOTE' then coalesce(max(k), 0) else 0 end as undecided
from effective left join u using (rule_id) group by 1, 2
