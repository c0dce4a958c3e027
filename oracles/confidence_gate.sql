with l as (select ['BLOCK','CONDITION','NOTE','INFO'][l_linenumber % 4 + 1] as severity, ['HIGH','MEDIUM','LOW'][l_suppkey % 3 + 1] as confidence from lineitem)
select severity, confidence,
 case when confidence='HIGH' then severity when confidence='MEDIUM' and severity='BLOCK' then 'CONDITION' when confidence='MEDIUM' then severity when severity in ('BLOCK','CONDITION') then 'NOTE' else severity end as strict,
 case when confidence in ('HIGH','MEDIUM') then severity when severity in ('BLOCK','CONDITION') then 'NOTE' else severity end as lenient,
 case confidence when 'HIGH' then 'MEDIUM' else 'LOW' end as lowered,
 case severity when 'BLOCK' then 3 when 'CONDITION' then 2 when 'NOTE' then 1 else 0 end as weight, count(*) as n
from l group by all
