-- uses: intents
select project_id || '/declared' as subject, 'undeclared use_saas' as problem from intents where use_licence_model = 'dual'
union all select project_id || '/declared', 'licence model' from intents where use_commercial
union all select project_id || '/declared', 'territory' from intents where list_contains(territories, 'cn')
