select doc_id, sha256(regexp_replace(replace(replace(text, chr(10), ' '), chr(13), ''), '([\\`*_\[\]<>|])', '\\\1', 'g')) as escaped,
 sha256(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' ')) as collapsed,
 n as clipped_chars
from (select doc_id, text, length(regexp_replace(regexp_replace(text, '^[\s\p{Z}\x0b\x{85}]+|[\s\p{Z}\x0b\x{85}]+$', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) as n from documents)
