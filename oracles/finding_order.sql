-- uses: rule_effective, all_undetermined
, a as (
 select project_id, case band when 'BLOCK' then 0 when 'CONDITION' then 1 else 2 end as s, -(case severity when 'BLOCK' then 3 when 'CONDITION' then 2 when 'NOTE' then 1 else 0 end) as o1,
  dependency_id as o2, rule_id as o3, '' as o4, dependency_id as subject, rule_id as what from rule_effective
 union all select project_id, 3, 0, kind, id, reason, id, reason from all_undetermined)
select project_id, row_number() over (partition by project_id order by s, o1, o2, o3, o4) as position, subject, what from a
