-- uses: needles
select d.doc_id, any_value(d.source) as source, arg_min(n.needle, n.ord) as needle, arg_min(n.spdx, n.ord) as spdx
from documents d left join needles n on contains(lower(d.text), 'licen') and contains(lower(d.text), n.needle)
group by d.doc_id
