select * from (select 'g' || c_custkey as subject, unnest([
  case when c_nationkey = 3 then 'no territory' end, case when c_custkey % 3 = 1 then 'severity' end, case when c_custkey % 3 = 2 then 'confidence' end,
  case when c_custkey % 2 = 1 or (c_custkey // 2) % 2 = 1 then 'citation' end]) as problem from customer) where problem is not null
