-- uses: all_undetermined
select project_id, id, case reason when 'licence_unresolved' then 'E-SCAN-011' when 'no_corpus_entry' then 'E-POLICY-001' else 'E-POLICY-009' end as error_code,
 case reason when 'licence_unresolved' then 'read the licence text and declare its identifier' when 'no_corpus_entry' then 'add an entry for this licence to the corpus' else 'declare the missing fact' end as action from all_undetermined
