with c as (select c_custkey as k, c_mktsegment as s from customer where c_custkey % 7 not in (0, 1))
select k::varchar as org, 'exception' as what, '0' as key, 'npm:a@' || k || '||r|o|2026-12-31' as value from c
union all select k::varchar, 'exception', '1', 'go:b@1|t.x|s|' || s || '|2026-01-31' from c
union all select k::varchar, 'family', 'weak-copyleft', 'BLOCK' from c
union all select k::varchar, 'licence', 'MPL-' || k, 'CONDITION' from c
