-- uses: verdicts
select project_id, verdict, case verdict when 'DO_NOT_SHIP' then 1 else 0 end as plain,
 case verdict when 'DO_NOT_SHIP' then 1 when 'UNDETERMINED' then 5 else 0 end as strict,
 case verdict when 'SHIP' then 0 else 1 end as fail_on_condition, case verdict when 'SHIP' then 0 else 1 end as strict_fail_on_note from verdicts
