-- uses: sarif_rows
select project_id, rule_id, cast(row_number() over (partition by project_id order by rule_id) - 1 as integer) as rule_index, level
from (select project_id, rule_id, arg_min(level, [case when rule_id like 'lexfleet.%' then '3' when level = 'error' then '0' when level = 'warning' then '1' else '2' end, item_id]) as level from sarif_rows group by 1, 2)
