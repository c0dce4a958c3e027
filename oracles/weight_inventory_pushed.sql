-- uses: weight_files
-- a GGUF file here is its text plus 91 bytes and the licence, a zip its text plus 130
select project_id, format, count(*) as files, true as large from weight_files
where format <> 'SafeTensors' and body + case format when 'GGUF' then 91 + length(licence) else 130 end >= 200 and project_id <> 's-none' group by 1, 2
