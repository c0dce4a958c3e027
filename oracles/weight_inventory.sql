-- uses: weight_files
select project_id, rel, format, format = 'PyTorch (zip)' as has_pickle, licence as gguf_licence, false as gguf_truncated from weight_files
