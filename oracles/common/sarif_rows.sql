-- uses: rule_effective, all_undetermined, deps
select r.project_id, r.dependency_id as item_id, r.rule_id, case band when 'BLOCK' then 'error' when 'CONDITION' then 'warning' else 'note' end as level, d.evidence_path as uri, d.evidence_line as start_line from rule_effective r join deps d on d.project_id = r.project_id and d.id = r.dependency_id
union all
select u.project_id, u.id, 'lexfleet.undetermined.' || reason, 'warning', d.evidence_path, d.evidence_line from all_undetermined u join deps d on d.project_id = u.project_id and d.id = split_part(u.id, '#', 1)
