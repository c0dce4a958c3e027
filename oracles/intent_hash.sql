-- uses: intents
select project_id, 'sha256:' || sha256('schema_version=1' || chr(10) || 'project.name=' || project_name || chr(10) || 'use.commercial=' || use_commercial || chr(10) || 'use.licence_model=' || use_licence_model || chr(10)
 || 'use.modified=' || use_modified || chr(10) || 'use.network_exposed=' || use_network_exposed || chr(10) || 'use.distributed=' || use_distributed || chr(10) || 'use.saas=' || use_saas || chr(10)
 || 'scale.mau.declared=' || (scale_mau is not null) || chr(10) || 'scale.mau=' || coalesce(scale_mau,0) || chr(10)
 || 'scale.employees.declared=' || (scale_employees is not null) || chr(10) || 'scale.employees=' || coalesce(scale_employees,0) || chr(10)
 || 'scale.revenue_eur.declared=' || (scale_revenue_eur is not null) || chr(10) || 'scale.revenue_eur=' || coalesce(scale_revenue_eur,0) || chr(10)
 || 'territories=' || coalesce(array_to_string(list_sort(territories), ','), '') || chr(10)
 || 'policy.never_allow=' || case when use_licence_model < 'GPL-3.0-only' then use_licence_model || ',GPL-3.0-only' else 'GPL-3.0-only,' || use_licence_model end || chr(10) || 'policy.block_on=BLOCK' || chr(10)) as intent_hash
from intents
