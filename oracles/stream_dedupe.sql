-- uses: event_findings
select project_id, count(distinct finding_id) as findings from event_findings group by 1
