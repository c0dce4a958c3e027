-- uses: obligation_hits, eval_rows
, said as (
 select project_id, 'E-POLICY-009' as code, 'undeclared: scale.mau' as message from obligation_hits where unknown
 union all select project_id, 'E-POLICY-001', 'no entry for ' || coalesce(nullif(trim(spdx), ''), nullif(trim(raw), ''), 'no licence declared') || ' (' || id || ')' from eval_rows where entry_spdx is null and resolved)
select project_id, row_number() over (partition by project_id order by code, message) as position, code, message from said
