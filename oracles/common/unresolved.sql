-- uses: eval_rows
select project_id, intent_id, id as dependency_id, kind as dep_kind, case when not resolved then 'licence_unresolved' else 'no_corpus_entry' end as reason
from eval_rows where entry_spdx is null
