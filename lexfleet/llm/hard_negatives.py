"""Hard negatives: rows of another label that score just below an anchor's positives.

All rows lie in STR-packed R-trees. Sort-tile-recursive order cuts the table into slabs
by one coordinate and each slab by a second; Spark does that with one range
partitioning, ties broken by further values down to the id, so a hot vector is spread
over tasks. A task reads its range in tiles of TILE rows and packs each tile by further
coordinates into leaves with minimum bounding boxes, four of which make a node above.

A box gives an interval for every coordinate, and the sum of the intervals' products
with the anchor's coordinates bounds the inner products of all rows in it. The search
takes boxes from a queue, highest bound first. It drops a box that lies outside all
score windows, or strictly below the k-th score found so far (an equal one may hold a
smaller id). What remains is exact: no row that counts is left out.

Anchors are a stated set; they are compared with all rows in blocks of about ANCHORS,
and only a block (its vectors, and at most `positives` windows for each) is collected
and broadcast. Every task gives its own best rows of each anchor and window; those are
merged by a window over at most k rows a task.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; vectors of different length have no score with each other; an
id that several rows carry counts once, with its least label and vector; ties go to the
smaller id; other columns are not looked at; an empty table gives an empty table.
Components must be whole numbers, and scores must fit a long (else the job ends).
"""

from heapq import heapify, heappop, heappush
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexfleet.llm import common

TILE = 4096  # rows of a tree
LEAF = 128
FANOUT = 4
ANCHORS = 16_384  # in a block, about
BLOCK_NUMBERS = 4 << 20  # components of a block, about: 32 MB
ROWS_PER_TASK = 1 << 18
SAMPLE = 4096  # rows that the choice of coordinates and slabs is fitted on, about
SLABS = 256
EXACT = float(1 << 53)


class Tree:
    """Boxes over the rows of one tile, packed in sort-tile-recursive order."""

    def __init__(self, ids, labels, rows):
        n, dim = rows.shape
        parts = -(-n // LEAF)
        spread = np.argsort(-rows.std(axis=0), kind="stable")[: max(1, (parts - 1).bit_length())]
        leaves = list(self._pack(rows, np.arange(n), spread.tolist()))
        order = np.concatenate(leaves)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.starts = np.cumsum([0, *map(len, leaves)]).tolist()
        least = [np.minimum.reduceat(self.rows, self.starts[:-1]) if dim else np.zeros((len(leaves), 0))]
        most = [np.maximum.reduceat(self.rows, self.starts[:-1]) if dim else np.zeros((len(leaves), 0))]
        while len(least[-1]) > 1:
            at = np.arange(0, len(least[-1]), FANOUT)
            least.append(np.minimum.reduceat(least[-1], at) if dim else np.zeros((len(at), 0)))
            most.append(np.maximum.reduceat(most[-1], at) if dim else np.zeros((len(at), 0)))
        self.sizes = [len(x) for x in least]  # of each level, leaves first
        self.first = np.cumsum([0, *self.sizes]).tolist()  # nodes are numbered through the levels
        self.least, self.most = np.concatenate(least), np.concatenate(most)
        self.reach = float(np.abs(rows).max(initial=0.0))

    def _pack(self, rows, index, coordinates):
        if len(index) <= LEAF or not coordinates:
            for lo in range(0, len(index), LEAF):
                yield index[lo : lo + LEAF]
            return
        leaves = -(-len(index) // LEAF)
        slices = ceil(leaves ** (1 / len(coordinates)))
        size = -(-leaves // slices) * LEAF
        index = index[np.argsort(rows[index, coordinates[0]], kind="stable")]
        for lo in range(0, len(index), size):
            yield from self._pack(rows, index[lo : lo + size], coordinates[1:])

    def bounds(self, anchors):
        """The highest and lowest inner product that a row of each box can have."""
        up, down = np.maximum(anchors, 0.0), np.minimum(anchors, 0.0)
        high, low = up @ self.most.T + down @ self.least.T, up @ self.least.T + down @ self.most.T
        if not self.exact(anchors):  # sums may be rounded
            slack = np.abs(anchors) @ np.maximum(np.abs(self.least), np.abs(self.most)).T * 2.0**-40
            high, low = high + slack, low - slack
        return high, low

    def exact(self, anchors):
        """Whether sums of products are whole numbers that doubles hold."""
        return self.reach * float(np.abs(anchors).max(initial=0.0)) * max(1, self.rows.shape[1]) < EXACT

    def scores(self, leaf, anchor, exact):
        rows = self.rows[self.starts[leaf] : self.starts[leaf + 1]]
        if exact:
            return (rows @ anchor).astype(np.int64)
        a = [int(x) for x in anchor.tolist()]
        return np.array([sum(int(x) * y for x, y in zip(r, a)) for r in rows.tolist()], object)

    def search(self, anchor, high, low, exact, wanted, offer):
        """Offer leaves to an anchor, best bound first, until no box can matter. wanted(high,
        low): whether a box may still hold a row that counts."""
        top = len(self.sizes) - 1
        queue = [(-high[node], top, node) for node in range(self.first[top], self.first[top + 1]) if wanted(high[node], low[node])]
        heapify(queue)
        while queue:
            _, level, node = heappop(queue)
            if not wanted(high[node], low[node]):
                continue
            if not level:
                part = slice(self.starts[node], self.starts[node + 1])
                offer(self.ids[part], self.labels[part], self.scores(node, anchor, exact))
                continue
            below = self.first[level - 1]
            child = below + (node - self.first[level]) * FANOUT
            for c in range(child, min(child + FANOUT, self.first[level])):
                if wanted(high[c], low[c]):
                    heappush(queue, (-high[c], level - 1, c))


class Best:
    """The k best rows with scores from `lo` to `hi` (None: any), ties to the smaller id."""

    __slots__ = ("k", "lo", "hi", "rows")

    def __init__(self, k, lo=None, hi=None):
        self.k, self.lo, self.hi, self.rows = k, lo, hi, []

    def floor(self):
        """Rows and boxes strictly below this score cannot count."""
        kth = -self.rows[-1][0] if len(self.rows) == self.k else None
        return self.lo if kth is None else kth

    def wants(self, high, low):
        floor = self.floor()
        return (self.hi is None or low <= self.hi) and (floor is None or high >= floor)

    def offer(self, ids, scores, fit):
        floor = self.floor()
        if floor is not None:
            fit = fit & (scores >= floor)
        if self.hi is not None:
            fit = fit & (scores <= self.hi)
        at = np.flatnonzero(fit)
        if len(at) > 4 * self.k and scores.dtype != object:
            at = at[scores[at] >= np.partition(scores[at], -self.k)[-self.k]]
        if len(at):
            self.rows = sorted(self.rows + [(-s, i) for s, i in zip(scores[at].tolist(), ids[at].tolist())])[: self.k]


def _vectors(column):
    """An Arrow list column as a table per run of equal lengths: (first row, rows)."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            end = at + (hi - lo) * int(size[lo])
            yield lo, flat[at:end].reshape(hi - lo, int(size[lo])).astype(np.float64)
            at = end


def _trees(batches):
    """Trees over the tiles of a task's rows (id, label, vector), in their order."""
    held, count = [], 0

    def tree():
        return Tree(*(np.concatenate(x) for x in zip(*held)))

    for b in batches:
        ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        for lo, rows in _vectors(b.column("vector")):
            if held and held[0][2].shape[1] != rows.shape[1]:
                yield tree()
                held, count = [], 0
            at = 0
            while at < len(rows):
                some = rows[at : at + TILE - count]
                held.append((ids[lo + at : lo + at + len(some)], labels[lo + at : lo + at + len(some)], some))
                at, count = at + len(some), count + len(some)
                if count == TILE:
                    yield tree()
                    held, count = [], 0
    if held:
        yield tree()


class Anchors:
    """A block of anchors of one length, and of each the lists that it fills."""

    def __init__(self, ids, labels, vectors, lists, same):
        self.ids, self.labels, self.vectors, self.lists, self.same = ids, labels, vectors, lists, same

    def visit(self, tree):
        exact = tree.exact(self.vectors)
        high, low = tree.bounds(self.vectors)
        for i, (anchor, lists) in enumerate(zip(self.vectors, self.lists)):
            ident, label = self.ids[i], self.labels[i]

            def wanted(high, low):
                return any(best.wants(high, low) for best in lists)

            def offer(ids, labels, scores):
                fit = (labels == label) & (ids != ident) if self.same else labels != label
                for best in lists:
                    best.offer(ids, scores, fit)

            tree.search(anchor, high[i].tolist(), low[i].tolist(), exact, wanted, offer)


def _by_length(block):
    """Anchors (id, label, vector) as one set of arrays for each length."""
    out = {}
    for row in block:
        out.setdefault(len(row[2]), []).append(row)
    return {n: ([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.float64).reshape(len(rows), n)) for n, rows in out.items()}


def _best_rows(tiles: DataFrame, block, windows, k, same) -> DataFrame:
    """anchor, list, score, row: what each task finds for the lists of each anchor. windows:
    id -> list of (lo, hi), and an anchor without any has no lists."""
    sc = tiles.sparkSession.sparkContext
    sent = sc.broadcast((_by_length(block), windows))
    arrow = to_arrow_type(tiles.schema["id"].dataType)

    def run(batches):
        common.claim()
        by_length, bounds = sent.value
        sets = {n: Anchors(ids, labels, vectors, [[Best(k, lo, hi) for lo, hi in bounds[i]] for i in ids], same) for n, (ids, labels, vectors) in by_length.items()}
        for tree in _trees(batches):
            if tree.rows.shape[1] in sets:
                sets[tree.rows.shape[1]].visit(tree)
        rows = [(i, n, -score, row) for s in sets.values() for i, lists in zip(s.ids, s.lists) for n, best in enumerate(lists) for score, row in best.rows]
        for lo in range(0, len(rows), 65_536):
            anchor, n, score, row = zip(*rows[lo : lo + 65_536])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, arrow), pa.array(n, pa.int32()), pa.array(score, pa.int64()), pa.array(row, arrow)], names=["anchor", "list", "score", "row"])

    kind = tiles.schema["id"].dataType.simpleString()
    found = tiles.mapInArrow(run, f"anchor {kind}, list int, score long, row {kind}")
    order = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rows(df, id_col, vec_col, label_col, anchors):
    """The rows that take part: id, label, vector, anchor; every id once."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))


def _tiles(rows: DataFrame, n: int, widest: float) -> DataFrame:
    """The rows in sort-tile-recursive order, one range of it per partition."""
    spark = rows.sparkSession
    every = max(1, n // SAMPLE)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vector").limit(4 * SAMPLE).collect()
    sizes = [len(r[0]) for r in sample]
    length = max(set(sizes), key=sizes.count) if sizes else 0
    slab, second = F.lit(0), F.lit(0.0)
    if length:
        table = np.array([r[0] for r in sample if len(r[0]) == length])
        spread = np.argsort(-table.std(axis=0), kind="stable")[:2].tolist()
        slabs = min(SLABS, isqrt(-(-n // TILE) - 1) + 1)
        cuts = np.unique(np.quantile(table[:, spread[0]], np.arange(1, slabs) / slabs)).tolist()
        of_length = F.size("vector") == length
        if cuts:
            slab = F.when(of_length, F.size(F.filter(F.lit(cuts), lambda c: c <= F.get("vector", F.lit(spread[0]))))).otherwise(0)
        second = F.when(of_length, F.get("vector", F.lit(spread[-1]))).otherwise(0.0)
    # whole numbers of few bytes take little room on the way
    kind = "smallint" if widest < 1 << 15 else "int" if widest < 1 << 31 else "double"
    keyed = rows.select("id", "label", F.col("vector").cast(f"array<{kind}>").alias("vector"), "anchor", F.size("vector").alias("size"), slab.alias("slab"), second.alias("second"))
    keys = ["size", "slab", "second", "id"]
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return common.staged(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "label", "vector", "anchor"))


def mine(df: DataFrame, anchors: Column, id_col="vec_id", vec_col="embedding", label_col="label", positives=5, negatives=3, least=50, most=95) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels whose score is `least` to `most` percent of the
    positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. anchors: which rows of `df` are anchors."""
    spark = df.sparkSession
    common.ship(spark)
    rows = _rows(df, id_col, vec_col, label_col, anchors)
    facts = rows.agg(F.count("*"), F.count_distinct("id"), F.max(F.array_max(F.transform("vector", F.abs))), F.max(F.size("vector")), F.count_if("anchor")).first()
    n, ids, widest, length, asked = facts[0], facts[1], facts[2] or 0.0, facts[3] or 0, facts[4]
    if n > ids:
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("one")).select("id", "one.*")
    kind = rows.schema["id"].dataType.simpleString()
    out = spark.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    if not asked:
        return out
    tiles = _tiles(rows, ids, widest)
    blocks = -(-asked // max(1, min(ANCHORS, BLOCK_NUMBERS // max(length, 1))))
    for i in range(blocks):
        block = [(r.id, r.label, r.vector) for r in tiles.filter("anchor").filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).select("id", "label", "vector").collect()]
        near = {}
        for r in _best_rows(tiles, block, {a: [(None, None)] for a, _, _ in block}, positives, True).orderBy("anchor", "rank").collect():
            near.setdefault(r.anchor, []).append((r.row, r.score))
        # percent of a whole number, rounded into the window
        windows = {a: [(-(-least * s // 100), most * s // 100) for _, s in near.get(a, [])] for a, _, _ in block}
        found = _best_rows(tiles, block, windows, negatives, False)
        pairs = [(a, k, p, s) for a, ps in near.items() for k, (p, s) in enumerate(ps)]
        known = spark.createDataFrame(pairs, f"anchor {kind}, list int, positive_id {kind}, positive_score long")
        out = out.union(common.staged(found.join(F.broadcast(known), ["anchor", "list"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    return out
