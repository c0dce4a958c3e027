-- uses: parts
select p_partkey, ecosystem || ':' || name || '@' || version as id, name as display, 'vendored:third_party/ ' || name as local_id from parts
