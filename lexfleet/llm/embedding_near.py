"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into two halves, each half has its own codebook, and the two
codebooks span a grid of cells. Every vector is in one cell. As a query it visits
cells in the order of the multi-sequence algorithm (least sum of both half
distances first) until the number of cells that reached the target recall on a
query set, times a margin; a cell that cannot hold a partner by the triangle
inequality is passed over. All vectors of visited cells are compared exactly.

The codebooks are fitted on a bounded sample (SAMPLE rows by hash of the id). The
number of visits is fitted on QUERIES other rows by hash, each compared with all rows in
Spark, so small groups are seen whatever the size of the table. Queries count once each
and are ranked apart by their number of links, so a large group does not hide small
ones; if no query has a link, made-up partners at the threshold take their place. What
the query set found is logged as a warning and stands in the index's `report`. All rows are indexed and all are queries. Cells with many vectors
or many queries are cut into blocks, and a block pair is one task's work. Equal
vectors are one from the start. A pair counts for both vectors if either visits the
other's cell, so links are symmetric.

A cell that holds nothing is not visited: a bitmap of the occupied cells goes to every
task. Vectors move as they came, and are made unit vectors again where they are compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts link
with nothing, and those of different length not with each other; rows with a null id have a null component and are not kept; repeated rows
are equal vectors; other columns are not looked at; an empty table gives an empty
table.
"""

import hashlib
import heapq
import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common, graph

THRESHOLD = 0.95
SAMPLE = 16384
QUERIES = 4096
PER_CELL = 64
MAX_CODES = 2048  # per half, so codebooks are bounded
TARGET_RECALL, MARGIN, LEAST_VISITS = 0.999, 2, 8
BLOCK = 1024
FEW = 1024  # vectors of a length that need no index
ROUNDS = 8


def clean(values):
    """Unit vector in double precision, or None."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum())


def codebook(points, size, rounds=ROUNDS):
    """Lloyd's algorithm from evenly spread rows of the sample."""
    codes = points[np.linspace(0, len(points) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = distances(points, codes).argmin(axis=1)
        for k in np.unique(near):
            codes[k] = points[near == k].mean(axis=0)
    return np.unique(codes, axis=0)


def distances(points, codes):
    d = (points * points).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes * codes).sum(axis=1)
    return np.maximum(d, 0)


class Index:
    def __init__(self, sample, codes, threshold, recall=TARGET_RECALL):
        self.size, self.threshold = sample.shape[1], threshold
        self.cut = max(1, self.size // 2)
        halves = self._halves(sample)
        self.books = [codebook(h, min(codes, len(sample))) if h.shape[1] else np.zeros((1, 0)) for h in halves]
        self.visits = self._calibrate(sample, recall)

    def _halves(self, x):
        return x[:, : self.cut], x[:, self.cut :]

    @property
    def grid(self):
        return len(self.books[0]) * len(self.books[1])

    def _tables(self, x):
        """Per half: squared distance to each code and least squared distance to the code's cell."""
        out = []
        for h, book in zip(self._halves(x), self.books):
            d = distances(h, book)
            own = d.argmin(axis=1)
            least = d[np.arange(len(h)), own]
            apart = np.sqrt(distances(book, book))[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = np.where(apart > 0, (d - least[:, None]) / (2 * apart), 0.0)
            out.append((d, own, np.maximum(border, 0) ** 2))
        return out

    def cells(self, x):
        a, b = self._tables(x)
        return a[1] * len(self.books[1]) + b[1]

    def visited(self, x, visits=None):
        """Own cell and the visited cells of each vector."""
        (d1, own1, low1), (d2, own2, low2) = self._tables(x)
        wide, reach = len(self.books[1]), 2 - 2 * self.threshold + 1e-9
        visits = self.visits if visits is None else visits
        m = min(visits, d1.shape[1]), min(visits, d2.shape[1])
        order1, order2 = np.argsort(d1, axis=1, kind="stable")[:, : m[0]], np.argsort(d2, axis=1, kind="stable")[:, : m[1]]
        out = []
        for r in range(len(x)):
            o1, o2, heap, got = order1[r], order2[r], [(0.0, 0, 0)], []
            while heap and len(got) < visits:
                _, i, j = heapq.heappop(heap)
                got.append((o1[i], o2[j]))
                if j + 1 < m[1]:
                    heapq.heappush(heap, (d1[r, o1[i]] + d2[r, o2[j + 1]], i, j + 1))
                if j == 0 and i + 1 < m[0]:
                    heapq.heappush(heap, (d1[r, o1[i + 1]] + d2[r, o2[0]], i + 1, 0))
            out.append([int(a * wide + b) for a, b in got if low1[r, a] + low2[r, b] <= reach])
        return own1 * wide + own2, out

    def _calibrate(self, sample, recall):
        """Visits that find `recall` of the linked pairs of the sample, with a margin."""
        need = []
        cells = self.cells(sample)
        for lo in range(0, len(sample), 512):
            part = sample[lo : lo + 512]
            near = part @ sample.T >= self.threshold
            near[np.arange(len(part)), lo + np.arange(len(part))] = False
            (d1, _, _), (d2, _, _) = self._tables(part)
            wide = len(self.books[1])
            for r in np.flatnonzero(near.any(axis=1)):
                sums = (d1[r][:, None] + d2[r]).ravel()
                need += (sums < sums[cells[near[r]], None]).sum(axis=1).tolist()
        exact = int(np.quantile(need, recall, method="higher")) + 1 if need else 1
        return min(self.grid, max(LEAST_VISITS, MARGIN * exact))


    def ranks(self, query, cells):
        """How many cells come before each of `cells` in the order of one query."""
        d1, d2 = (distances(h, book)[0] for h, book in zip(self._halves(query[None]), self.books))
        second, wide = np.sort(d2), len(d2)
        return np.array([np.searchsorted(second, d1[c // wide] + d2[c % wide] - d1).sum() for c in cells])

    def raise_visits(self, need, recall=TARGET_RECALL):
        """need: (links, visits that find `recall` of them) of each query with links."""
        groups = {}
        for links, visits in need:
            groups.setdefault(int(links).bit_length(), []).append(visits)
        exact = max(int(np.quantile(v, recall, method="higher")) for v in groups.values())
        self.visits = min(self.grid, max(self.visits, MARGIN * exact))

    def made_up(self, queries):
        """What raise_visits() takes, for one partner at the threshold per query."""
        away = np.random.default_rng(0).normal(size=queries.shape)
        away -= (away * queries).sum(axis=1)[:, None] * queries
        norm = np.sqrt((away * away).sum(axis=1))[:, None]
        away = np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
        cells = self.cells(self.threshold * queries + np.sqrt(max(0.0, 1 - self.threshold**2)) * away)
        return [(1, int(self.ranks(q, [c])[0]) + 1) for q, c in zip(queries, cells)]


def units_of(raws, width):
    """Unit vectors, one per row, of raw vectors of one length; `width` bytes a component."""
    x = np.frombuffer(b"".join(raws), np.float32 if width == 4 else np.float64).reshape(len(raws), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rows(df, id_col, vector_col, width):
    """id, digest of the unit vector, the vector as it came (raw) and its length; null where
    it links with nothing. What is moved later is raw: half the bytes of a unit vector
    where components are floats."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            digests, raws, sizes = [], [], []
            for v in b.column("_vector").to_pylist():
                u = clean(v)
                digests.append(None if u is None else hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest())
                raws.append(None if u is None else np.asarray(v, np.float32 if width == 4 else np.float64).tobytes())
                sizes.append(None if u is None else len(u))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(digests, pa.binary()), pa.array(raws, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "digest", "raw", "size"])

    return df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector")).mapInArrow(run, f"id {kind}, digest binary, raw binary, size int")


def fit(units: DataFrame, threshold=THRESHOLD, sample=SAMPLE, queries=QUERIES, width=8) -> Index:
    """units: rep, digest, raw, all of one length. Brings `sample` and `queries` rows at most
    to the driver. The index's `report` says what the query set found."""
    n = units.count()
    rows = units.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("raw").toArrow().column("raw").to_pylist()
    x = units_of(rows, width)
    index = Index(x, max(2, min(MAX_CODES, int(np.sqrt(n / PER_CELL)))), threshold)
    asked = units.orderBy(F.xxhash64(F.lit("query"), "rep"), "rep").limit(queries).select("digest", "raw").toArrow()
    x = units_of(asked.column("raw").to_pylist(), width)
    need = _needed(units, index, x, asked.column("digest").to_pylist(), width)
    index.raise_visits([(r["links"], r["visits"]) for r in need] or index.made_up(x))
    index.report = {
        "vectors": n, "queries": len(x), "queries_with_links": len(need), "links": sum(r["links"] for r in need),
        "links_of_queries_in_reach": sum(r["links"] for r in need if r["visits"] <= index.visits), "visits": index.visits, "cells": index.grid, "target_recall": TARGET_RECALL}
    logging.getLogger(__name__).warning("embedding index: %s", index.report)
    return index


def _needed(units, index, queries, digests, width):
    """Rows (query, links, visits) of the queries that have links: each is compared with all units."""
    shared = units.sparkSession.sparkContext.broadcast((index, queries, digests))

    def links(batches):
        index, queries, digests = shared.value
        number = {d: i for i, d in enumerate(digests)}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = units_of(part.column("raw").to_pylist(), width)
                near = x @ queries.T >= index.threshold
                for r, d in enumerate(part.column("digest").to_pylist()):
                    if d in number:
                        near[r, number[d]] = False
                row, query = np.nonzero(near)
                pairs, n = np.unique(np.stack([query, index.cells(x)[row]], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(n, pa.int64())], names=["query", "cell", "n"])

    def visits(table):
        index, queries, _ = shared.value
        query, cells, n = table.column("query")[0].as_py(), table.column("cell").to_numpy(), table.column("n").to_numpy()
        ranks = index.ranks(queries[query], cells)
        order = np.argsort(ranks, kind="stable")
        at = np.searchsorted(np.cumsum(n[order]), TARGET_RECALL * n.sum())
        return pa.table({"query": [query], "links": [int(n.sum())], "visits": [int(ranks[order][min(at, len(n) - 1)]) + 1]})

    pairs = units.select("digest", "raw").mapInArrow(links, "query long, cell long, n long").groupBy("query", "cell").agg(F.sum("n").alias("n"))
    return pairs.groupBy("query").applyInArrow(visits, "query long, links long, visits long").collect()


def _occupied(units, index, width):
    """A bit for each cell of the grid that holds a vector: at most MAX_CODES ** 2 bits, 512 kB."""
    shared = units.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            cells = np.unique(np.concatenate([shared.value.cells(units_of(b.slice(lo, 512).column("raw").to_pylist(), width)) for lo in range(0, b.num_rows, 512)] or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 5, pa.int64()), pa.array(np.int64(1) << (cells & 31), pa.int64())], names=["word", "bits"])

    words = units.select("raw").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((index.grid + 31) // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _assign(units, index, kind, width, base):
    """Own cell and visited cells that hold anything; cells of this index are numbered from `base`."""
    shared = units.sparkSession.sparkContext.broadcast((index, _occupied(units, index, width)))

    def run(batches):
        index, held = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                own, visited = index.visited(units_of(part.column("raw").to_pylist(), width))
                visited = [[base + c for c in cells if held[c >> 5] >> np.uint32(c & 31) & np.uint32(1)] for cells in visited]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("raw"), pa.array(own + base, pa.int64()), pa.array(visited, pa.list_(pa.int64()))], names=["rep", "copies", "raw", "cell", "visited"])

    return units.mapInArrow(run, f"rep {kind}, copies long, raw binary, cell long, visited array<long>")


def forest(near, q, d):
    """Edges that connect all linked queries and vectors of a block pair. q and d: the
    number of the vector behind each row and column."""
    label, out = np.arange(max(q.max(), d.max()) + 1), []
    for r in np.flatnonzero(near.any(axis=1)):
        linked = d[near[r]]
        roots, at = np.unique(label[linked], return_index=True)
        for root, k in zip(roots, at):
            if root != label[q[r]]:
                out.append((q[r], linked[k]))
                label[label == root] = label[q[r]]
    return out


def _compare(blocks, threshold, kind, width):
    """Per block pair: how many rows each vector links with (id, null, n), and edges (u, v, null)."""

    def run(table):
        side = np.array(table.column("side").to_pylist())
        q, d = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids = table.column("rep")
        if not len(q) or not len(d):
            return pa.table({"u": pa.array([], ids.type), "v": pa.array([], ids.type), "n": pa.array([], pa.int64())})
        x = units_of(table.column("raw").to_pylist(), width)
        copies = np.array(table.column("copies").to_pylist())
        # a vector is here as a query and maybe as a row of the cell: one number for both
        _, number = np.unique(np.array(ids.to_pylist()), return_inverse=True)
        near = x[q] @ x[d].T >= threshold
        near &= number[q][:, None] != number[d]
        counts = np.zeros(len(side), np.int64)
        counts[q] = near @ copies[d]
        cells, visited = np.array(table.column("cell").to_pylist()), table.column("visited").to_pylist()
        for k in np.flatnonzero(near.any(axis=0)):
            seen = np.isin(cells[q], visited[d[k]])  # those that this vector finds as a query itself
            counts[d[k]] = copies[q][near[:, k] & ~seen].sum()
        some = np.flatnonzero(counts)
        pairs, of = forest(near, number[q], number[d]), {n: i for i, n in enumerate(number)}
        u = ids.take(pa.array([*some.tolist(), *(of[a] for a, _ in pairs)], pa.int64()))
        v = ids.take(pa.array([*[None] * len(some), *(of[b] for _, b in pairs)], pa.int64()))
        return pa.table({"u": u, "v": v, "n": pa.array([*counts[some].tolist(), *[None] * len(pairs)], pa.int64())})

    return blocks.groupBy("at", "db", "qb").applyInArrow(run, f"u {kind}, v {kind}, n long")


def near_duplicates(df: DataFrame, threshold=THRESHOLD, id_col="vec_id", vector_col="embedding", sample=SAMPLE) -> DataFrame:
    """One row per row of `df`: id, n_links, component_id, kept."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    width = 4 if df.schema[vector_col].dataType.elementType.simpleString() == "float" else 8
    rows = common.staged(_rows(df, id_col, vector_col, width))
    valid = rows.filter("raw is not null and id is not null")
    units = common.staged(valid.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw"), F.first("size").alias("size")))
    none = F.lit(None).cast(kind)
    if units.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    # vectors of different length have no cosine: each length with many vectors has an index of its own,
    # vectors of a rarer length are all compared, as those of one cell
    lengths = units.groupBy("size").count().filter(F.col("count") > FEW).orderBy("size").collect()
    parts = []
    for k, r in enumerate(lengths):
        some = units.filter(F.col("size") == r["size"])
        parts.append(_assign(some, fit(some, threshold, sample, width=width), kind, width, k * MAX_CODES**2))
    rare = units.filter(~F.col("size").isin([r["size"] for r in lengths])) if lengths else units
    cell = -F.col("size").cast("long")
    parts.append(rare.select("rep", "copies", "raw", cell.alias("cell"), F.array(cell).alias("visited")))
    assigned = common.staged(reduce(lambda a, b: a.select("*", F.lit(0).alias("_")).drop("_").union(b.select("*", F.lit(0).alias("_")).drop("_")), parts))
    stored = assigned.select("rep", "copies", "raw", "cell", "visited", F.col("cell").alias("at"), F.lit(1).alias("side"))
    asked = assigned.select("rep", "copies", "raw", "cell", F.expr("cast(null as array<long>)").alias("visited"), F.explode("visited").alias("at"), F.lit(0).alias("side"))
    both = stored.unionByName(asked)
    sizes = both.groupBy("at").agg(F.ceil(F.sum("side") / BLOCK).cast("int").alias("dbs"), F.ceil(F.sum(1 - F.col("side")) / BLOCK).cast("int").alias("qbs")).filter("dbs > 0 and qbs > 0")
    cut = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    blocks = both.join(sizes, "at").withColumn("db", F.explode(F.when(F.col("side") == 1, F.array(cut("dbs"))).otherwise(every("dbs"))))
    blocks = blocks.withColumn("qb", F.explode(F.when(F.col("side") == 0, F.array(cut("qbs"))).otherwise(every("qbs"))))
    found = common.staged(_compare(blocks.select("at", "db", "qb", "side", "rep", "copies", "raw", "cell", "visited"), threshold, kind, width))
    linked = graph.components(found.filter("v is not null").select("u", "v"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    classes = units.select("digest", "rep", "copies").join(counts, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left")
    classes = classes.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest")).join(classes, "digest", "left")
    component = F.when(F.col("id").isNull(), none).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
