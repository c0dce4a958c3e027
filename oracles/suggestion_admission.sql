-- uses: answers
, a as (select *, item_id in (select case when lang = 'en' then 'doc:' else 'text:' end || doc_id from documents) as known from answers where problem is null),
e as (select * from a where trim(text) <> '')
select project_id, item_id, what, outcome, count(*) as n from (
 select project_id, item_id, case when known then 'explanation' else 'unknown id for explanation' end as what, case when known then 'kept' else 'E-AI-005' end as outcome from e
 union all select project_id, item_id, case when known then 'remediation' else 'unknown id for remediation' end, case when known then 'kept' else 'E-AI-005' end from a
 union all select project_id, item_id, 'refused to change the severity', 'E-AI-006' from a) group by all
