-- uses: deps, rules
, i(intent_id, net, modif, dist, comm, saas, mau) as (values ('internal',false,true,false,false,false,10),('hosted',true,true,false,true,true,null),('shipped',false,false,true,true,false,5)),
h as (select project_id, intent_id, mau, unnest([
  case when entry_spdx='AGPL-3.0-only' and net and modif then 'agpl-3.0.network-disclosure' end,
  case when entry_spdx='AGPL-3.0-only' and dist then 'agpl-3.0.licence-inclusion' end,
  case when entry_spdx='AGPL-3.0-only' and net and modif then 'trap.agpl.modified-network-service' end,
  case when entry_spdx='Apache-2.0' and dist then 'apache-2.0.licence-inclusion' end,
  case when entry_spdx='Apache-2.0' and dist then 'apache-2.0.notice-retention' end,
  case when entry_spdx='Apache-2.0' then 'apache-2.0.patent-grant' end,
  case when entry_spdx='Apache-2.0' and dist then 'apache-2.0.trademark-exclusion' end,
  case when entry_spdx='Apache-2.0' and dist then 'trap.patent.retaliation' end,
  case when entry_spdx='BSD-3-Clause' and dist then 'bsd-3-clause.source-retention' end,
  case when entry_spdx='BSD-3-Clause' and dist then 'bsd-3-clause.binary-reproduction' end,
  case when entry_spdx='BSD-3-Clause' and dist then 'bsd-3-clause.no-endorsement' end,
  case when entry_spdx='CC-BY-NC-4.0' and comm then 'cc-by-nc-4.0.non-commercial' end,
  case when entry_spdx='CC-BY-NC-4.0' and modif then 'cc-by-nc-4.0.non-commercial-adaptations' end,
  case when entry_spdx='CC-BY-NC-4.0' and dist then 'cc-by-nc-4.0.attribution' end,
  case when entry_spdx='CC-BY-NC-4.0' and comm and kind='weights' then 'trap.weights.cc-by-nc-commercial' end,
  case when entry_spdx='Elastic-2.0' and saas then 'elastic-2.0.managed-service' end,
  case when entry_spdx='Elastic-2.0' and modif then 'elastic-2.0.licence-key' end,
  case when entry_spdx='Elastic-2.0' then 'elastic-2.0.not-open-source' end,
  case when entry_spdx='Elastic-2.0' then 'trap.elastic.licence-confusion' end,
  case when entry_spdx='GPL-3.0-only' and dist then 'gpl-3.0.convey-verbatim' end,
  case when entry_spdx='GPL-3.0-only' and dist then 'gpl-3.0.binary-source-offer' end,
  case when entry_spdx='GPL-3.0-only' and dist then 'gpl-3.0.installation-information' end,
  case when entry_spdx='GPL-3.0-only' then 'gpl-3.0.patent-grant' end,
  case when entry_spdx='GPL-3.0-only' and net and not dist then 'gpl-3.0.no-network-clause' end,
  case when entry_spdx='GPL-3.0-only' and intent_id <> 'internal' then 'trap.gpl.proprietary-binary' end,
  case when entry_spdx='ISC' and dist then 'isc.permission-notice' end,
  case when entry_spdx='LGPL-3.0-only' and dist then 'lgpl-3.0.dynamic-linking-note' end,
  case when entry_spdx='LGPL-3.0-only' and dist then 'trap.lgpl.static-linking' end,
  case when entry_spdx='Llama-3.1-Community' and comm and mau is null then 'llama-3.1.mau-gate' end,
  case when entry_spdx='Llama-3.1-Community' and dist then 'llama-3.1.attribution' end,
  case when entry_spdx='Llama-3.1-Community' then 'llama-3.1.acceptable-use' end,
  case when entry_spdx='MIT' and dist then 'mit.attribution' end,
  case when entry_spdx='MIT' and dist then 'mit.no-patent-grant' end,
  case when entry_spdx='MPL-2.0' and dist then 'mpl-2.0.executable-notice' end,
  case when entry_spdx='MPL-2.0' and dist then 'mpl-2.0.larger-work' end,
  case when entry_spdx='MPL-2.0' then 'mpl-2.0.patent-termination' end,
  case when entry_spdx='SSPL-1.0' and saas then 'sspl-1.0.service-source' end,
  case when entry_spdx='SSPL-1.0' then 'sspl-1.0.not-open-source' end,
  case when entry_spdx='SSPL-1.0' then 'trap.sspl.not-open-source' end,
  case when spdx='BUSL-1.1' then 'trap.busl.conversion' end,
  case when not resolved then 'trap.licence.absent-all-rights-reserved' end]) as rule_id from deps, i),
f as (select project_id, intent_id, case when rule_id='llama-3.1.mau-gate' then 'NOTE' when confidence='MEDIUM' and severity='BLOCK' then 'CONDITION' else severity end as band,
        rule_id='llama-3.1.mau-gate' as unk from h join rules using (rule_id)),
g as (select project_id, intent_id, count(*) filter (band='BLOCK') b, count(*) filter (band='CONDITION') c, count(*) filter (band='NOTE') n, count(*) filter (unk) k from f group by 1,2),
u as (select project_id, intent_id, count(*) k from deps, i where entry_spdx is null group by 1,2),
p as (select 'o' || o_orderkey as project_id, intent_id from orders, i),
a as (select project_id, intent_id, coalesce(b,0) as blockers, coalesce(c,0) as conditions, coalesce(n,0) as notes, coalesce(g.k,0) + coalesce(u.k,0) as undetermined
      from p left join g using (project_id, intent_id) left join u using (project_id, intent_id))
select project_id, intent_id, case when blockers > 0 then 'DO_NOT_SHIP' when undetermined > 0 then 'UNDETERMINED' when conditions > 0 then 'SHIP_CONDITIONAL' else 'SHIP' end as verdict,
  blockers, conditions, notes, undetermined from a
