-- uses: part_licence
select p_partkey, replace(p_name,' ','-') || '-' || p_partkey as name, p_size || '.0.0' as version,
  case p_type when 'STANDARD' then 'npm' when 'SMALL' then 'pypi' when 'MEDIUM' then 'go' when 'LARGE' then 'cargo'
              when 'ECONOMY' then 'local' else 'weights' end as ecosystem,
  case p_type when 'PROMO' then 'weights' when 'ECONOMY' then 'vendored' else 'package' end as kind,
  l.raw, l.spdx, l.expression, l.resolved, l.licence_confidence,
  case when p_type = 'ECONOMY' then 'vendored_file' else 'manifest' end as licence_source,
  case when p_type = 'ECONOMY' then 'MIT' end as declared_licence
from part join part_licence l on l.brand = p_brand
