-- uses: page_hosts, platform_findings
, i as (select distinct project_id, unnest(['paid','free']) as intent_id from page_hosts),
f as (select project_id, intent_id, count(*) filter (effective_severity='BLOCK') b, count(*) filter (effective_severity='CONDITION') c, count(*) filter (effective_severity='NOTE') n from platform_findings group by 1, 2)
select project_id, intent_id, case when coalesce(b,0) > 0 then 'DO_NOT_SHIP' when coalesce(c,0) > 0 then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict,
 coalesce(b,0) as blockers, coalesce(c,0) as conditions, coalesce(n,0) as notes, 0 as undetermined from i left join f using (project_id, intent_id)
