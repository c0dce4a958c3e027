select doc_id, case doc_id % 5 when 0 then 'mit' when 1 then 'Apache 2.0|MIT' else '' end as raws, case doc_id % 5 when 0 then 'MIT' when 1 then 'Apache-2.0' else '' end as first from documents
