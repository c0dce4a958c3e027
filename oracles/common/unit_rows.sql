-- uses: parts
select 'u' || version as project_id, p_partkey, ecosystem, name, case when version not like '1%' then version else '1.0' end as version,
 case when version not like '1%' then 'lockfile' else 'manifest' end as source, p_partkey % 2 = 0 as direct, spdx, resolved from parts
