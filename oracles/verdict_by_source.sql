-- uses: document_prose, entries, rules
, hits as (
 select source, unnest(case spdx
   when 'Apache-2.0' then ['apache-2.0.licence-inclusion','apache-2.0.notice-retention','apache-2.0.patent-grant','apache-2.0.trademark-exclusion','trap.patent.retaliation']
   when 'MIT' then ['mit.attribution','mit.no-patent-grant']
   when 'ISC' then ['isc.permission-notice']
   when 'GPL-3.0-only' then ['gpl-3.0.convey-verbatim','gpl-3.0.binary-source-offer','gpl-3.0.installation-information','gpl-3.0.patent-grant','trap.gpl.proprietary-binary']
   when 'AGPL-3.0-only' then ['agpl-3.0.licence-inclusion']
   when 'LGPL-3.0-only' then ['lgpl-3.0.dynamic-linking-note','trap.lgpl.static-linking']
   when 'CC-BY-NC-4.0' then ['cc-by-nc-4.0.non-commercial','cc-by-nc-4.0.attribution']
   when 'BSD-3-Clause' then ['bsd-3-clause.source-retention','bsd-3-clause.binary-reproduction','bsd-3-clause.no-endorsement']
   when 'MPL-2.0' then ['mpl-2.0.executable-notice','mpl-2.0.larger-work','mpl-2.0.patent-termination']
   when 'SSPL-1.0' then ['sspl-1.0.not-open-source','trap.sspl.not-open-source']
   when 'Elastic-2.0' then ['elastic-2.0.not-open-source','trap.elastic.licence-confusion']
   when 'BUSL-1.1' then ['trap.busl.conversion']
   when 'Llama-3.1-Community' then ['llama-3.1.attribution','llama-3.1.acceptable-use','llama-3.1.mau-gate']
   else []::varchar[] end) as rule_id from document_prose where spdx is not null),
bands as (
 select source, case when rule_id = 'llama-3.1.mau-gate' then 'NOTE' when confidence = 'MEDIUM' and severity = 'BLOCK' then 'CONDITION' else severity end as band
 from hits join rules using (rule_id)),
f as (select source, count(*) filter (band='BLOCK') b, count(*) filter (band='CONDITION') c, count(*) filter (band='NOTE') n from bands group by 1),
u as (select source, count(*) u from document_prose where spdx is not null and (spdx = 'Llama-3.1-Community' or spdx not in (select entry_spdx from entries)) group by 1)
select s.source as project_id, 'ship' as intent_id,
 case when coalesce(b,0) > 0 then 'DO_NOT_SHIP' when coalesce(u,0) > 0 then 'UNDETERMINED' when coalesce(c,0) > 0 then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict,
 coalesce(b,0) as blockers, coalesce(c,0) as conditions, coalesce(n,0) as notes, coalesce(u,0) as undetermined
from (select distinct source from documents) s left join f on f.source = s.source left join u on u.source = s.source
