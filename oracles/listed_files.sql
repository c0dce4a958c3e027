select 's-' || coalesce(source, 'none') as project_id, 'docs/k' || (doc_id % 5) as directory, count(*) as files, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes
from documents where doc_id % 7 <> 0 group by 1, 2
