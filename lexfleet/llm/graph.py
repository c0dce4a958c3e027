"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on its least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang the smaller neighbours of every node, and the node, on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one sortable type, in any direction and number. One row per node
    that has an edge to another: node, component (the least node it reaches).

    Every step keeps at most as many edges as there were, and all aggregates combine
    before the shuffle. Nulls and self-loops are left out."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now = common.staged(now)
    mark = None
    while True:
        now = common.staged(_small_star(_large_star(now)))
        # a fixed point: the same edges as after the round before
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)
