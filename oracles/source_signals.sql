-- uses: source_hits
select project_id, rel, line, signal, token, confidence from source_hits
