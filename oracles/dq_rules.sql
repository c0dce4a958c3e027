with p as (select p_partkey as k from part),
r as (select k, 'r' || (k % 1500) as rule_id, k % 2 = 0 as ob, ['BLOCK','CONDITION','NOTE','INFO','FATAL'][k % 5 + 1] as severity from p)
select problem, count(*) as n from (
 select 'severity' as problem from r where severity = 'FATAL'
 union all select 'confidence' from r where k % 4 = 3
 union all select 'citation' from r where k % 9 = 0 or k % 8 in (0, 1, 2) and not (k % 8 = 0)
 union all select 'message' from r where ob and k % 12 < 10
 union all select 'title' from r where not ob and k % 6 = 2
 union all select 'obligation kind' from r where ob and k % 3 = 2
 union all select 'fix action' from r where k % 7 = 2
 union all select 'scope' from r where k % 4 = 3 or (k % 4 = 1 and ob)
 union all select 'duplicate id' from r group by rule_id having count(*) > 1) group by 1
