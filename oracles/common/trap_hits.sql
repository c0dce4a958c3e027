-- uses: eval_rows, rules
select h.*, severity, confidence from (
 select * from (
  select project_id, intent_id, id as dependency_id, kind as dep_kind, spdx as licence, unnest([
   case when use_network_exposed and use_modified and entry_family = 'network-copyleft' then 'trap.agpl.modified-network-service' end,
   case when spdx = 'BUSL-1.1' then 'trap.busl.conversion' end,
   case when kind = 'weights' and entry_family = 'non-commercial' and use_commercial then 'trap.weights.cc-by-nc-commercial' end,
   case when entry_family = 'strong-copyleft' and use_licence_model = 'closed-source' then 'trap.gpl.proprietary-binary' end,
   case when spdx = 'LGPL-3.0-only' and use_distributed then 'trap.lgpl.static-linking' end,
   case when not resolved then 'trap.licence.absent-all-rights-reserved' end,
   case when spdx = 'Apache-2.0' and use_distributed then 'trap.patent.retaliation' end,
   case when spdx = 'SSPL-1.0' then 'trap.sspl.not-open-source' end,
   case when spdx = 'Elastic-2.0' then 'trap.elastic.licence-confusion' end]) as rule_id
  from eval_rows) where rule_id is not null) h join rules using (rule_id)
