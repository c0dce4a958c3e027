select conv_id, turn, (conv_id % 10)::varchar as project_id, conv_id * 1000 + turn as seq, 'doc:' || conv_id as item_id, text,
 case when conv_id % 4 <> 0 and conv_id % 17 = 5 then 'the answer is no JSON object' when turn % 5 = 4 then 'the answer is for another job' end as problem
from conversations
