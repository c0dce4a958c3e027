-- uses: all_findings
select *, case confidence when 'HIGH' then severity when 'MEDIUM' then case severity when 'BLOCK' then 'CONDITION' else severity end
   else case when severity in ('BLOCK','CONDITION') then 'NOTE' else severity end end as effective_severity from all_findings
