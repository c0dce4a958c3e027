-- uses: document_prose
select doc_id, needle, spdx from document_prose
