-- uses: source_hits
, g as (select project_id, signal, lower(token) as key, arg_min(token, [rel, lpad(line::varchar, 6, '0')]) as name, min([rel, lpad(line::varchar, 6, '0')]) as place, bool_or(confidence='high') as high from source_hits group by 1, 2, 3)
select project_id, 'upstream_cli:' || key as id, name, signal, case when high then 'high' else 'medium' end as licence_confidence, place[1] as evidence_path, place[2]::integer as evidence_line
from g qualify row_number() over (partition by project_id, key order by signal desc) = 1
