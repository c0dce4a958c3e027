-- uses: excepted, entries
, w as (select x.*, case severity when 'BLOCK' then 3 when 'CONDITION' then 2 when 'NOTE' then 1 else 0 end as cur,
  case org when 'a' then greatest(case entry_family when 'weak-copyleft' then 3 when 'permissive' then 1 else 0 end, case licence when 'ISC' then 3 when 'MPL-2.0' then 2 else 0 end) else case licence when 'ISC' then 2 else 0 end end as up
 from excepted x left join entries on entry_spdx = licence where owner is null)
, r as (select project_id, dependency_id, rule_id, severity as corpus_severity, case up when 3 then 'BLOCK' when 2 then 'CONDITION' else 'NOTE' end as severity, confidence from w where up > cur)
select *, case confidence when 'HIGH' then severity when 'MEDIUM' then case severity when 'BLOCK' then 'CONDITION' else severity end else case when severity in ('BLOCK','CONDITION') then 'NOTE' else severity end end as effective_severity from r
