-- uses: answers
select project_id, seq, item_id, case when turn % 2 = 1 then 'high' else '' end as effort, case conv_id % 3 when 0 then 'use other (Apache 2.0)' when 1 then '' else 'unknown thing' end as alternative, conv_id % 3 <> 2 as verified
from answers where problem is null
