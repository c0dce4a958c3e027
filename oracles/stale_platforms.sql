-- uses: page_platform
select distinct project_id, 'E-CORPUS-011' as code, 'terms of beta last verified 2025-01-01, outside its 180-day window' as message from page_platform where platform = 'beta'
