with d as (select doc_id, lower((['This licence does not grant permission to use the trade names or logo.','The trademark may be shown by anyone.',
 'Some parts are reserved by their authors and are not covered here.','All product names remain the property of their owners.',''])[doc_id % 5 + 1] || chr(10) || regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
n as (select doc_id, t, regexp_matches(t, 'trademark|trade mark|trade name|service mark|logo|brand name|name and logo|names and logos|product name') as noun from d)
select doc_id, noun, noun and regexp_matches(t, 'not covered|not grant|not licensed|not included|not conveyed|not permitted|no right|are excluded|remain the property|are reserved|requires permission|prior written permission|not authorized to use|may not use') as reserved from n
