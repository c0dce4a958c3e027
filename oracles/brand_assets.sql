-- uses: part_text
select project_id, 'asset:' || x.d as id, x.d as name, x.s as scope, x.c as licence_confidence, x.e as evidence_path, x.g as signal from (
 select project_id, unnest([
  {'d': 'app/node_modules/m' || k, 's': 'app', 'c': 'high', 'e': 'app/node_modules/m' || k || '/TRADEMARKS.md', 'g': 'trademark_file'},
  {'d': 'node_modules/n', 's': '.', 'c': 'medium', 'e': 'node_modules/n/brand', 'g': 'brand_directory'},
  {'d': 'node_modules/n/brand', 's': '.', 'c': 'medium', 'e': 'node_modules/n/brand/icon.png', 'g': 'brand_filename'}]) as x from part_text)
