"""Run named queries against their oracle SQL in DuckDB and compare whole results.

    python tests/check_oracles.py [sf_dir] [name ...]
"""
import datetime, math, os, sys, time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(canon(x)) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", took, True
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", took, False
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return f"ok {len(a)}", took, True
    only_a, only_b = list(set(a) - set(b))[:3], list(set(b) - set(a))[:3]
    return f"DIFF {len(a)} vs {len(b)}\n   columns {sorted(names)}\n   spark only {only_a}\n   sql only   {only_b}", took, False


def connect(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from lexfleet import session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = session.configure(SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
                              .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls, con, bad = entry.queries(), entry.oracle_sql(), connect(sf), []
    for name in args or queries:
        try:
            message, took, ok = compare(spark, con, sf, name, queries[name], sqls.get(name))
        except Exception as err:  # report every query, then fail
            message, took, ok = f"ERROR {str(err)[:1500]}", 0, False
        print(f"{name:28s} {took:6.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("stray sql:", sorted(set(sqls) - set(queries)))
    print("failed:", bad)
    sys.exit(bool(bad))
