-- uses: deps, intents
select d.*, i.* exclude (project_id) from deps d join intents i using (project_id)
