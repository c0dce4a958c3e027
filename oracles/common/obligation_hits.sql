-- uses: eval_rows, rules
-- one row per obligation that fires, UNKNOWN marked; conditions written out by hand
select h.*, case when unknown then 'NOTE' else severity end as severity, case when unknown then 'LOW' else confidence end as confidence
from (
 select project_id, intent_id, id as dependency_id, kind as dep_kind, spdx as licence, x.rule_id, x.unknown from (
  select *, unnest(case entry_spdx
   when 'AGPL-3.0-only' then [
     {'rule_id': case when use_network_exposed and use_modified then 'agpl-3.0.network-disclosure' end, 'unknown': false},
     {'rule_id': case when use_network_exposed and not use_modified then 'agpl-3.0.network-unmodified' end, 'unknown': false},
     {'rule_id': case when use_modified and use_distributed then 'agpl-3.0.modified-source' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'agpl-3.0.licence-inclusion' end, 'unknown': false}]
   when 'Apache-2.0' then [
     {'rule_id': case when use_distributed then 'apache-2.0.licence-inclusion' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'apache-2.0.notice-retention' end, 'unknown': false},
     {'rule_id': case when use_modified and use_distributed then 'apache-2.0.state-changes' end, 'unknown': false},
     {'rule_id': 'apache-2.0.patent-grant', 'unknown': false},
     {'rule_id': case when use_distributed then 'apache-2.0.trademark-exclusion' end, 'unknown': false}]
   when 'BSD-3-Clause' then [
     {'rule_id': case when use_distributed then 'bsd-3-clause.source-retention' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'bsd-3-clause.binary-reproduction' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'bsd-3-clause.no-endorsement' end, 'unknown': false}]
   when 'CC-BY-NC-4.0' then [
     {'rule_id': case when use_commercial then 'cc-by-nc-4.0.non-commercial' end, 'unknown': false},
     {'rule_id': case when use_modified then 'cc-by-nc-4.0.non-commercial-adaptations' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'cc-by-nc-4.0.attribution' end, 'unknown': false}]
   when 'Elastic-2.0' then [
     {'rule_id': case when use_saas then 'elastic-2.0.managed-service' end, 'unknown': false},
     {'rule_id': case when use_modified then 'elastic-2.0.licence-key' end, 'unknown': false},
     {'rule_id': 'elastic-2.0.not-open-source', 'unknown': false}]
   when 'GPL-3.0-only' then [
     {'rule_id': case when use_distributed then 'gpl-3.0.convey-verbatim' end, 'unknown': false},
     {'rule_id': case when use_modified and use_distributed then 'gpl-3.0.modified-source' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'gpl-3.0.binary-source-offer' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'gpl-3.0.installation-information' end, 'unknown': false},
     {'rule_id': 'gpl-3.0.patent-grant', 'unknown': false},
     {'rule_id': case when use_network_exposed and not use_distributed then 'gpl-3.0.no-network-clause' end, 'unknown': false}]
   when 'ISC' then [{'rule_id': case when use_distributed then 'isc.permission-notice' end, 'unknown': false}]
   when 'LGPL-3.0-only' then [
     {'rule_id': case when use_modified and use_distributed then 'lgpl-3.0.modified-library-source' end, 'unknown': false},
     {'rule_id': case when use_modified and use_distributed then 'lgpl-3.0.combined-work-relink' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'lgpl-3.0.dynamic-linking-note' end, 'unknown': false}]
   when 'Llama-3.1-Community' then [
     {'rule_id': case when use_commercial and (scale_mau is null or scale_mau > 700000000) then 'llama-3.1.mau-gate' end, 'unknown': scale_mau is null},
     {'rule_id': case when use_distributed then 'llama-3.1.attribution' end, 'unknown': false},
     {'rule_id': 'llama-3.1.acceptable-use', 'unknown': false}]
   when 'MIT' then [
     {'rule_id': case when use_distributed then 'mit.attribution' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'mit.no-patent-grant' end, 'unknown': false}]
   when 'MPL-2.0' then [
     {'rule_id': case when use_modified and use_distributed then 'mpl-2.0.source-disclosure' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'mpl-2.0.executable-notice' end, 'unknown': false},
     {'rule_id': case when use_distributed then 'mpl-2.0.larger-work' end, 'unknown': false},
     {'rule_id': 'mpl-2.0.patent-termination', 'unknown': false}]
   when 'SSPL-1.0' then [
     {'rule_id': case when use_saas then 'sspl-1.0.service-source' end, 'unknown': false},
     {'rule_id': 'sspl-1.0.not-open-source', 'unknown': false}]
   end) as x from eval_rows) where x.rule_id is not null) h join rules using (rule_id)
