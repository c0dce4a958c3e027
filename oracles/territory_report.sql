-- uses: intents
, g(territory, gate_id) as (values ('CN','territory.cn.algorithm-filing'),('CN','territory.cn.cross-border-data'),('EU','eu.database-right'),('EU','eu.ai-act-transparency'),('GB','gb.database-right'),('GB','gb.uk-gdpr'),('US','us.dmca-anticircumvention'),('US','us.export-control'))
, t as (select project_id, intent_id, upper(unnest(territories)) as territory from intents)
select project_id, intent_id, territory, gate_id, 'NOTE' as gate_severity from t join g using (territory)
