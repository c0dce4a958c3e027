-- uses: deps
select project_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || (['8','9','a','b'])[(instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1] || substr(h,18,3) || '-' || substr(h,21,12) as uuid
from (select project_id, sha256('lexfleet|' || project_id || '|0|' || count(*) || '|' || sum(cast(('0x' || substr(sha256(id),1,15)) as hugeint))) as h from deps group by 1)
