-- uses: answers
, a as (select *, trim(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) as body from answers where problem is null)
select project_id, 'explanation' as kind, item_id, min(seq) as seq, cast(arg_min(case when length(body) > 4096 then 4097 else length(body) end, seq) as integer) as chars from a where body <> '' group by 1, 2, 3
union all select project_id, 'remediation', item_id, min(seq), 7 from a group by 1, 2, 3
