-- uses: files
select *, regexp_extract(rel, '[^/]*$') as base, case when contains(rel, '/') then regexp_extract(rel, '^(.*)/[^/]*$', 1) else '.' end as dir,
  len(list_intersect(string_split(rel, '/'), ['node_modules','vendor','third_party','bower_components','site-packages','dist-packages','jspm_packages'])) > 0 as in_tree from files
