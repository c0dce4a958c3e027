-- uses: phrase_docs
, norm as (
 select doc_id, k, trim(regexp_replace(lower(translate(replace(text, chr(65279), ''), chr(8216)||chr(8217)||chr(8220)||chr(8221)||chr(8211)||chr(8212)||chr(160)||chr(8239)||chr(133)||chr(8195)||chr(8201),
   ''''''||'""--'||'     ')), '[\s]+', ' ', 'g')) as n from phrase_docs)
select doc_id, length(n) as norm_chars, sha256(n) as norm_sha,
 (['AGPL-3.0-only','LGPL-3.0-only','GPL-3.0-only','GPL-2.0-only','SSPL-1.0','Elastic-2.0','BUSL-1.1','MPL-2.0','Apache-2.0','CC-BY-NC-4.0','CC-BY-4.0','CC0-1.0',
   'BSD-3-Clause','BSD-2-Clause','ISC','MIT','Zlib','Unlicense',null])[k + 1] as spdx
from norm
