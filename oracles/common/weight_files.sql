select 's-' || coalesce(source, 'none') as project_id, 'm/' || doc_id || '.dat' as rel, doc_id, octet_length(encode(coalesce(text, ''))) as body,
 ['GGUF', 'SafeTensors', 'PyTorch (zip)'][doc_id % 5 + 1] as format, case when doc_id % 5 = 0 then ['mit', 'apache-2.0', ''][doc_id % 3 + 1] else '' end as licence
from documents where doc_id % 5 < 3
