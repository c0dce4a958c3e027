-- uses: parts
select p_partkey * 2 as ordinal, ecosystem || ':' || name || '@' || version as dependency, null as kind, 'legal' as owner,
  case when p_partkey % 2 = 0 then '2026-12-31' else '2026-01-31' end as expires from parts where ecosystem in ('npm','go')
union all
select case when p_partkey % 9 = 0 then p_partkey * 2 - 1 else p_partkey * 2 + 1 end, ecosystem || ':' || name || '@' || version, 'trap.licence.absent-all-rights-reserved', 'platform', '2026-09-23'
from parts where raw in ('','see LICENSE','Foo OR Bar')
