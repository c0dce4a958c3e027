-- uses: intents
, v as (
select project_id, unnest([
 {'predicate':'commercial','t':use_commercial,'field':null::varchar},
 {'predicate':'not_saas','t':not use_saas,'field':null},
 {'predicate':'model_in','t':use_licence_model in ('dual','open-source'),'field':null},
 {'predicate':'big','t':scale_mau > 700000000,'field':'scale.mau'},
 {'predicate':'small_team','t':scale_employees <= 250,'field':'scale.employees'},
 {'predicate':'rich','t':scale_revenue_eur >= 200000,'field':'scale.revenue_eur'},
 {'predicate':'name_has_7','t':contains(project_name,'7'),'field':null},
 {'predicate':'either','t':scale_mau < 500000000 or scale_employees < 100,'field':case when scale_mau is null then 'scale.mau' else 'scale.employees' end},
 {'predicate':'both','t':scale_employees <> 7 and scale_revenue_eur = 5,'field':case when scale_employees is null then 'scale.employees' else 'scale.revenue_eur' end},
 {'predicate':'negated','t':not (use_modified and scale_mau > 100000000),'field':'scale.mau'}]) as x from intents)
select project_id, x.predicate as predicate, case when x.t then 'TRUE' when not x.t then 'FALSE' else 'UNKNOWN' end as truth, case when x.t is null then x.field end as field from v
