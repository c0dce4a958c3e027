-- uses: answers
select project_id, seq, problem as message from answers where problem is not null
