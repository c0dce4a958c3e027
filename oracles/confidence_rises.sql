with v as (select doc_id, case when toxic = 1 then 'LOW' else 'MEDIUM' end as o, case when quality = 1 then 'HIGH' else 'MEDIUM' end as n, case when doc_id % 2 = 0 then 'MEDIUM' end as f from labels)
select 'licenseref-' || doc_id as spdx, o as old_confidence, n as confidence, coalesce(f = o, false) as explained from v where not (o = 'MEDIUM' and n = 'MEDIUM')
