select l_orderkey, l_linenumber, l_partkey, 'f_' || substr(sha256('npm:' || l_partkey || chr(0) || 'rule.' || l_linenumber), 1, 12) as finding_id from lineitem
