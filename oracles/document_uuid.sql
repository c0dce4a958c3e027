-- uses: uuids
select * from uuids
