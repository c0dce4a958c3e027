-- uses: deps, uuids
select project_id, 'CycloneDX' as format, 'urn:uuid:' || any_value(uuid) as serial, cast(count(*) as integer) as components, cast(count(*) filter (direct) as integer) as direct, sum(('0x' || substr(md5(id), 1, 8))::bigint)::bigint as refs
from deps join uuids using (project_id) group by 1
