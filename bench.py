"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median wall time is
reported. Results are computed in full, and the plan looked at is the final one of
that very execution. `nested_loops` lists queries whose final plan holds a nested-loop
or cartesian join; it should be empty. `shuffle_mb` and `input_mb` are what one run of
a query wrote to shuffles and read from tables.
"""

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from lexfleet import session  # noqa: E402
from lexfleet.plans import load_queries  # noqa: E402

HEADLINE = [
    "verdict_by_source", "licence_prose", "licence_recognise", "upsert_last_wins", "obligation_findings", "trap_findings", "what_if_intents",
    "weights_divergence", "declared_vs_actual", "org_exceptions", "verdict_counts", "verdict_fold", "platform_clauses", "longest_prefix_owner", "unit_discovery",
    "go_mod_blocks", "sbom_components", "sarif_rules",
]


def moved(spark):
    """Shuffle and input bytes of the application so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark._jsc.sc().statusStore().executorList(True)
    each = [executors.apply(i) for i in range(executors.size())]
    return sum(e.totalShuffleWrite() for e in each), sum(e.totalInputBytes() for e in each)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    shuffle = os.environ.get("BENCH_SHUFFLE", cpus if cpus.isdigit() else "8")
    spark = session.configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("lexfleet-bench").config("spark.sql.shuffle.partitions", shuffle)
        # vectored reads are not counted as input
        .config("spark.hadoop.parquet.hadoop.vectored.io.enabled", "false")
        .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, nested, shuffled, read = load_queries(), {}, [], {}, {}
    for name in names:
        times = []
        for i in range(runs + 1):
            before, start = moved(spark), time.time()
            execution = queries[name](spark, sf)._jdf.queryExecution()
            execution.toRdd().count()
            if i:
                times.append(time.time() - start)
        after, plan = moved(spark), execution.executedPlan().toString()
        shuffled[name], read[name] = (round((a - b) / 1e6, 2) for a, b in zip(after, before))
        if re.search("CartesianProduct|BroadcastNestedLoopJoin", plan):
            nested.append(name)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf.rstrip("/").split("sf")[-1], "runs": runs, "nested_loops": nested, "shuffle_mb": shuffled, "input_mb": read}))
    spark.stop()


if __name__ == "__main__":
    main()
