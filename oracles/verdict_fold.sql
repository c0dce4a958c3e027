-- uses: verdicts
select * from verdicts
