-- rule id, severity, confidence
select * from (values
 ('agpl-3.0.network-disclosure','BLOCK','HIGH'),('agpl-3.0.network-unmodified','CONDITION','MEDIUM'),
 ('agpl-3.0.modified-source','BLOCK','HIGH'),('agpl-3.0.licence-inclusion','CONDITION','HIGH'),
 ('apache-2.0.licence-inclusion','CONDITION','HIGH'),('apache-2.0.notice-retention','CONDITION','HIGH'),
 ('apache-2.0.state-changes','CONDITION','HIGH'),('apache-2.0.patent-grant','NOTE','HIGH'),('apache-2.0.trademark-exclusion','NOTE','HIGH'),
 ('bsd-3-clause.source-retention','CONDITION','HIGH'),('bsd-3-clause.binary-reproduction','CONDITION','HIGH'),('bsd-3-clause.no-endorsement','NOTE','HIGH'),
 ('cc-by-nc-4.0.non-commercial','BLOCK','HIGH'),('cc-by-nc-4.0.non-commercial-adaptations','CONDITION','HIGH'),('cc-by-nc-4.0.attribution','CONDITION','HIGH'),
 ('elastic-2.0.managed-service','BLOCK','MEDIUM'),('elastic-2.0.licence-key','CONDITION','MEDIUM'),('elastic-2.0.not-open-source','NOTE','MEDIUM'),
 ('gpl-3.0.convey-verbatim','CONDITION','HIGH'),('gpl-3.0.modified-source','BLOCK','HIGH'),('gpl-3.0.binary-source-offer','CONDITION','HIGH'),
 ('gpl-3.0.installation-information','NOTE','MEDIUM'),('gpl-3.0.patent-grant','NOTE','HIGH'),('gpl-3.0.no-network-clause','NOTE','MEDIUM'),
 ('isc.permission-notice','CONDITION','HIGH'),
 ('lgpl-3.0.modified-library-source','CONDITION','HIGH'),('lgpl-3.0.combined-work-relink','CONDITION','HIGH'),('lgpl-3.0.dynamic-linking-note','NOTE','MEDIUM'),
 ('llama-3.1.mau-gate','CONDITION','MEDIUM'),('llama-3.1.attribution','CONDITION','MEDIUM'),('llama-3.1.acceptable-use','CONDITION','MEDIUM'),
 ('mit.attribution','CONDITION','HIGH'),('mit.no-patent-grant','NOTE','MEDIUM'),
 ('mpl-2.0.source-disclosure','CONDITION','HIGH'),('mpl-2.0.executable-notice','CONDITION','HIGH'),('mpl-2.0.larger-work','NOTE','HIGH'),('mpl-2.0.patent-termination','NOTE','HIGH'),
 ('sspl-1.0.service-source','BLOCK','MEDIUM'),('sspl-1.0.not-open-source','NOTE','MEDIUM'),
 ('trap.agpl.modified-network-service','BLOCK','HIGH'),('trap.busl.conversion','CONDITION','MEDIUM'),('trap.weights.cc-by-nc-commercial','BLOCK','HIGH'),
 ('trap.code-weights-divergence','CONDITION','HIGH'),('trap.declared-vs-actual-conflict','CONDITION','HIGH'),('trap.assets.brand-reserved','CONDITION','HIGH'),
 ('trap.gpl.proprietary-binary','BLOCK','HIGH'),('trap.lgpl.static-linking','CONDITION','HIGH'),('trap.licence.absent-all-rights-reserved','BLOCK','MEDIUM'),
 ('trap.patent.retaliation','NOTE','HIGH'),('trap.sspl.not-open-source','BLOCK','MEDIUM'),('trap.elastic.licence-confusion','CONDITION','MEDIUM')
) t(rule_id, severity, confidence)
