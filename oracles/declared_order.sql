-- uses: part_text
, d as (select project_id, unnest([
  {'n': 'b' || k, 'v': '2.0', 'l': 1}, {'n': lower('a-' || n), 'v': '1.0', 'l': 2}, {'n': 'b' || k, 'v': '10.0', 'l': 3}, {'n': 'zz', 'v': '1', 'l': 4}, {'n': 'a' || v, 'v': '', 'l': 5}]) as x from part_text)
select project_id, row_number() over (partition by project_id order by x.n, x.v, x.l) as position, x.n as name, x.v as version from d
