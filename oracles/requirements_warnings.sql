-- uses: part_text
select project_id, 'E-PARSE-002' as code, x.l as line, x.s as skip from (select project_id, unnest([{'l':1,'s':'include'},{'l':2,'s':'directive'},{'l':4,'s':'url'}]) as x from part_text)
