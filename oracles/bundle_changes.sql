select doc_id, true as proven from documents where contains(text, '@')
