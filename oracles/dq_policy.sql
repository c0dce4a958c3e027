with p as (select p_partkey as k from part)
select what, problem, count(*) as n from (
 select 'exception' as what, 'no dependency' as problem from p where k % 4 = 1
 union all select 'exception', 'no reason' from p where k % 5 = 1
 union all select 'exception', 'no owner' from p where k % 3 = 2
 union all select 'exception', 'no expiry' from p where k % 6 = 1
 union all select 'exception', 'expiry is no date' from p where k % 6 in (2, 3)
 union all select 'escalation', 'no target' from p where k % 6 = 3
 union all select 'escalation', 'unknown family' from p where k % 2 = 0 and k % 6 = 2
 union all select 'escalation', 'not a severity' from p where k % 5 = 3
 union all select 'escalation', 'may not lower' from p where k % 5 = 1) group by all
