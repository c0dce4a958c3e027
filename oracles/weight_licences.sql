-- uses: weight_files
select project_id, 'weights:' || rel as id, doc_id || '.dat' as name, case licence when 'mit' then 'MIT' when 'apache-2.0' then 'Apache-2.0' else '' end as spdx,
 case when licence <> '' then 'weight_metadata' else 'unresolved' end as licence_source, licence <> '' as resolved, format,
 case when licence = '' then 'licence_not_found' end as reason, case when licence = '' then 'E-SCAN-010' end as error_code from weight_files
