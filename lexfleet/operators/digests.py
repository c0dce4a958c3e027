"""Digests of sets of rows that do not depend on order, paging or partitioning.

Merkle trees: a leaf is a named item; its place is the hash of its name, sixteen ways
at a time. Every level is one aggregate over the level below, so a node reads at most
sixteen children (leaves share a place only as far as hashes do), and no task sees the
whole. Two trees are compared level by level from the root: only subtrees that differ
are looked at. A proof names the siblings on the way up; it gives the root again.

Multiset hashes: the sum of item hashes, in four numbers that add without overflow.
Partial sums of any parts merge to the sum of the whole.
"""

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.session import materialise

FANOUT_HEX = 1  # characters of the place that one level takes: sixteen children
HEX = "0123456789abcdef"


def depth_for(count: int) -> int:
    """Levels at which about one leaf stands under a node."""
    return max(1, ceil(log(max(count, 2), 16)))


def leaves(rows: DataFrame, name: str, content: Column) -> DataFrame:
    """name, place, digest: one leaf per row. A null content is told from an empty one."""
    place = F.sha2(F.col(name).cast("string").cast("binary"), 256)
    body = F.when(content.isNull(), F.lit("-")).otherwise(F.sha2(content.cast("binary"), 256))
    return rows.select(F.col(name), place.alias("place"), F.sha2(F.concat_ws(":", F.lit("leaf"), place, body), 256).alias("digest"))


def _joined(order: str) -> Column:
    """Digest over the children's digests, in the order of a column."""
    cells = F.array_sort(F.collect_list(F.struct(order, "digest")))
    return F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform(cells, lambda c: c["digest"]), "")), 256)


def merkle(leaf_rows: DataFrame, depth: int = None) -> DataFrame:
    """level, prefix, digest of every node; level 0 is the root (no row without leaves)."""
    depth = depth or depth_for(leaf_rows.count())
    level = leaf_rows.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(_joined("place").alias("digest")).withColumn("level", F.lit(depth))
    level = materialise(level.select("level", "prefix", "digest"))
    nodes = [level]
    for k in range(depth - 1, -1, -1):
        above = level.groupBy(F.substring("prefix", 1, k).alias("up")).agg(_joined("prefix").alias("digest"))
        level = materialise(above.select(F.lit(k).alias("level"), F.col("up").alias("prefix"), "digest"))
        nodes.append(level)
    return reduce(lambda a, b: a.union(b.select(*(F.concat(F.col(c), F.lit("")).alias(c) if c != "level" else F.col(c) + F.lit(0) for c in b.columns))), nodes)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes that differ between two trees of one depth: level, prefix, before, after.
    Children are compared only below nodes that differ."""
    depth = (before.union(after)).agg(F.max("level")).first()[0]
    if depth is None:
        return before.select("level", "prefix", F.col("digest").alias("before"), F.col("digest").alias("after"))
    out, above = [], None
    for k in range(depth + 1):
        some = [d.filter(F.col("level") == k) for d in (before, after)]
        if above is not None:
            some = [d.join(above, F.substring("prefix", 1, k - 1) == F.col("up"), "left_semi") for d in some]
        a, b = some[0].alias("a"), some[1].alias("b")
        both = a.join(b, F.col("a.prefix") == F.col("b.prefix"), "full").filter(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
        rows = materialise(both.select(F.lit(k).alias("level"), F.coalesce("a.prefix", "b.prefix").alias("prefix"), F.col("a.digest").alias("before"), F.col("b.digest").alias("after")))
        if rows.isEmpty():
            break
        out.append(rows)
        above = rows.select(F.col("prefix").alias("up"))
    return reduce(lambda a, b: a.unionByName(b), out) if out else before.limit(0).select("level", "prefix", F.col("digest").alias("before"), F.col("digest").alias("after"))


def proofs(asked: DataFrame, leaf_rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """name, place, digest, beside (leaves at the same bottom node: place and digest), path
    (per level, bottom first: the children of the node above, prefix and digest). asked:
    a column of leaf names. At most sixteen entries a level come with a proof."""
    name = asked.columns[0]
    # written once: a plan that took it twice a level would double with every level
    own = materialise(leaf_rows.join(asked.distinct(), name).withColumn("prefix", F.substring("place", 1, depth)))
    paths = None
    for k in range(1, depth + 1):  # from the root down, where few nodes stand: a path per node, not per leaf
        children = nodes.filter(F.col("level") == k).groupBy(F.substring("prefix", 1, k - 1).alias("up")).agg(F.array_sort(F.collect_list(F.struct("prefix", "digest"))).alias("step"))
        at = own.select(F.substring("prefix", 1, k - 1).alias("up"), F.substring("prefix", 1, k).alias("at")).distinct().join(children, "up")
        above = at.withColumn("path", F.array("step")) if paths is None else at.join(paths, "up").withColumn("path", F.concat(F.array("step"), "path"))
        paths = above.select(F.col("at").alias("up"), "path")
    wanted = own.select("prefix").distinct()
    bottom = leaf_rows.withColumn("prefix", F.substring("place", 1, depth)).join(wanted, "prefix", "left_semi").groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("beside"))
    return own.join(bottom.join(paths.withColumnRenamed("up", "prefix"), "prefix"), "prefix").select(name, "place", "digest", "beside", "path")


def root_of(digest: Column, place: Column, beside: Column, path: Column, depth: int) -> Column:
    """The root that a leaf's digest and its proof give: at every level the way's own node
    takes the place of the recorded one."""
    node = lambda digests: F.sha2(F.concat(F.lit("node:"), F.array_join(digests, "")), 256)
    at = node(F.transform(beside, lambda c: F.when(c["place"] == place, digest).otherwise(c["digest"])))

    def above(step, prefix):
        own = lambda now: lambda c: F.when(c["prefix"] == prefix, now).otherwise(c["digest"])
        return lambda now: node(F.transform(step, own(now)))

    for i in range(depth):
        at = _with(at, above(F.get(path, F.lit(i)), F.substring(place, 1, depth - i)))
    return at


def _with(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- multisets ---------------------------------------------------------------------------

SUMS = ["s0", "s1", "s2", "s3"]


def sums(rows: DataFrame, keys, text: str) -> DataFrame:
    """keys, n, s0 ... s3: sums over the hashes of a text column; null is no item."""
    out = sums_of(rows, keys, [text])
    return out.select(*keys, "n", *(F.col(f"{text}_{s}").alias(s) for s in SUMS))


def sums_of(rows: DataFrame, keys, texts) -> DataFrame:
    """The same for several texts of an item in one aggregate: keys, n (of the first), and
    the sums of each, which begin with its name."""
    hashed = rows.select(*keys, *texts, *(F.sha2(F.col(t), 256).alias(f"{t}_h") for t in texts))
    part = lambda t, i: F.conv(F.substring(f"{t}_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*keys).agg(F.count(texts[0]).alias("n"), *(
        F.coalesce(F.sum(part(t, i)), F.lit(0)).cast("decimal(38,0)").alias(f"{t}_{s}") for t in texts for i, s in enumerate(SUMS)))


def merged(parts: DataFrame, keys) -> DataFrame:
    """Sums of parts as those of the whole."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(s).cast("decimal(38,0)").alias(s) for s in SUMS))


def multiset_hash(prefix="") -> Column:
    """One hash of the columns that `sums` gives."""
    return F.sha2(F.concat_ws("-", F.col("n").cast("string"), *(F.col(prefix + s).cast("string") for s in SUMS)), 256)
