-- uses: parts, entries
select p_partkey, raw, spdx, entry_spdx, entry_family, entry_permissiveness,
  case when spdx <> '' then spdx when raw <> '' then raw else 'no licence declared' end as licence
from parts left join entries on upper(entry_spdx) = upper(spdx)
