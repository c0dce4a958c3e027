-- uses: deps
select project_id, id, case when not resolved then 'licence_unresolved' else 'no_corpus_entry' end as reason from deps where entry_spdx is null
