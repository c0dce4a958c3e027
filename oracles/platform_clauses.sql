-- uses: platform_findings
select * from platform_findings
