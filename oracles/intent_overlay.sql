-- uses: intents
select project_id, coalesce(scale_mau, 5) as scale_mau, coalesce(scale_employees, 7) as scale_employees, use_saas,
 concat_ws(',', case when not use_saas then 'use_saas' end, case when scale_mau <> 5 then 'scale_mau' end, case when scale_employees <> 7 then 'scale_employees' end) as overridden from intents
