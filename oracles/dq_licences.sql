-- uses: licence_problems
select subject, problem from licence_problems where problem is not null
