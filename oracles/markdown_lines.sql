-- uses: rule_effective, all_undetermined, intents
select project_id, case band when 'BLOCK' then 0 when 'CONDITION' then 1 else 2 end as section, count(*) as items, count(*) filter (band <> severity) as gated from rule_effective group by 1, 2
union all select project_id, 3, count(*), 0 from all_undetermined group by 1
union all select project_id, unnest([-1, 9]), 0, 0 from intents
