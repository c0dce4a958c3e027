-- uses: intents, rule_effective, all_undetermined
, said as (
 select project_id, concat_ws('|', case band when 'BLOCK' then 'blockers' when 'CONDITION' then 'conditions' else 'notes' end, dependency_id, rule_id, severity, confidence, case when rule_id like 'trap.%' then rule_id else '' end) as t,
  case band when 'BLOCK' then 3 when 'CONDITION' then 1 else 0 end as weight from rule_effective
 union all select project_id, concat_ws('|', '?', id, kind, reason), 2 from all_undetermined)
, added as (
 select i.project_id, coalesce(max(weight), 0) as w, count(t) as items, coalesce(sum(('0x' || substr(sha256(t), 1, 15))::bigint), 0) as s0, coalesce(sum(('0x' || substr(sha256(t), 16, 15))::bigint), 0) as s1,
  coalesce(sum(('0x' || substr(sha256(t), 31, 15))::bigint), 0) as s2, coalesce(sum(('0x' || substr(sha256(t), 46, 15))::bigint), 0) as s3
 from intents i left join said using (project_id) group by 1)
select project_id, ['SHIP', 'SHIP_CONDITIONAL', 'UNDETERMINED', 'DO_NOT_SHIP'][w + 1] as verdict, items,
 sha256(concat_ws('-', items, s0, s1, s2, s3)) as sha256, true as same, true as same_whole from added
