select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber desc, l_suppkey desc, l_extendedprice desc, l_shipdate desc) = 1
