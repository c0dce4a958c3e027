"""N-gram Jaccard join: documents whose sets of five-word shingles are alike.

Exact at the threshold. Shingles are 64-bit hashes; exact copies of a set are one
set from the first step on. In one global order of the shingles (those that are
very frequent last, by a count sketch of fixed size over all documents) two alike
sets share shingles at the front of both: of the first n - ceil(t n) + l shingles of
a set at least l are also at the front of any partner. Sets with fewer shared ones
are out, pairs with fewer are no candidates, and sets that candidates connect form
a family.

A family is compared in tiles: its sets fall into bands of size (partners lie in the
same band or the next) and each band into blocks. In a tile every set has a bitmap
of hashed shingles. Bits that one bitmap has and the other lacks bound the overlap
from above; only pairs that pass are intersected as sorted arrays. A tile returns a
spanning forest of its links, so a family of any size never becomes all its pairs.

Defined cases: null and empty texts, and texts without words, have the empty set and
are linked with nothing; with fewer words than a shingle the whole sequence is one;
repeated rows are copies; rows with a null id have a null component; other columns
are not looked at; an empty table gives an empty table.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common, graph

WORDS = 5
THRESHOLD = (75, 100)
SKETCH_BITS = 18
SHARE = 10  # a tenth of a set's shingles is asked for beyond the first shared one
STEP = 1 << 20
FEW = 32  # sets of a shingle up to which it gives pairs
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18
FRONT_ROWS = 1 << 19  # per part of the front table, and held before they are packed
SEEN_SETS = 1 << 18  # of a task, whose equal sets are sent once
BROADCAST_IDS = 4 << 20  # ids, 32 MB

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(h):
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base, n):
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])


def word_hashes(texts):
    """Hashes of all words of a list of texts, and how many each text has."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    x = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    starts_of = np.cumsum([0, *(len(r) + 1 for r in raw)])
    at = np.flatnonzero(~_GAP[x])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    sizes = np.diff(np.r_[first, len(at)])
    within = at - np.repeat(at[first], sizes)
    letters = (_LOWER[x[at]] + np.uint64(1)) * _powers(np.uint64(0x9E3779B97F4A7C15), int(sizes.max()))[within]
    hashes = mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64))
    return hashes, np.diff(np.searchsorted(at[first], starts_of))


def shingle_sets(texts, words=WORDS):
    """The set of each text as a sorted array of hashes."""
    hashes, counts = word_hashes(texts)
    salts = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    full = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        full += hashes[k : k + len(full)] * salts[k]
    full = mix(full)
    out, lo = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(full[lo : lo + n - words + 1]))
        elif n:
            out.append(mix((hashes[lo : lo + n] * salts[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        lo += n
    return out


def _sets(batch, words):
    """(row numbers, sets) of an Arrow batch, some texts at a time."""
    for start in range(0, batch.num_rows, 512):
        texts = batch.column("_text").slice(start, 512).to_pylist()
        for lo, hi in common.steps(texts, STEP):
            yield from zip(range(start + lo, start + hi), shingle_sets(texts[lo:hi], words))


def digest(s):
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def set_key(d):
    return int.from_bytes(d[:8], "little", signed=True)


def _measure(docs, words):
    """Per row: id, set size and digest; and the count sketch as chunks."""
    chunks, width = 16, (1 << SKETCH_BITS) // 16

    def run(batches):
        common.claim()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in common.slices(batches, 2048):
            n, d = [], []
            for _, s in _sets(b, words):
                n.append(len(s))
                d.append(digest(s))
                if len(s):
                    sketch += np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=["_id", "n", "digest", "chunk", "counts"])
        if sketch.any():
            id_type = b.column("_id").type
            parts = [sketch[k * width : (k + 1) * width].astype(np.uint32).tobytes() for k in range(chunks)]
            yield pa.RecordBatch.from_arrays([pa.nulls(chunks, id_type), pa.nulls(chunks, pa.int64()), pa.nulls(chunks, pa.binary()), pa.array(range(chunks), pa.int32()), pa.array(parts, pa.binary())], names=["_id", "n", "digest", "chunk", "counts"])

    return common.staged(docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, n long, digest binary, chunk int, counts binary"))


def _heavy(measured):
    """For each bucket of the sketch, how many doublings it has over the mean. The
    sketch has a fixed size whatever the data; chunks are summed by Spark first."""

    def add(batches):
        total = {}
        for b in batches:
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "total"])

    rows = measured.filter("chunk is not null").select("chunk", "counts").repartition(16, "chunk").mapInArrow(add, "chunk int, total binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    counts = np.concatenate([np.frombuffer(r["total"], np.int64) for r in sorted(rows, key=lambda r: r["chunk"])])
    mean = max(4.0, counts.mean())
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / mean))).astype(np.uint8)


def least_shared(n, threshold=THRESHOLD):
    """Shingles that a set of n at least shares with any partner, by arrays or ints."""
    return -(-n * threshold[0] // threshold[1])


def extra(n):
    return 1 + n // SHARE


def front(s, heavy, threshold=THRESHOLD):
    """The first shingles of a set in the global order."""
    n = len(s)
    size = min(n, n - least_shared(n, threshold) + extra(n))
    rank = heavy[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")[:size]]


def _fronts(docs, heavy, parts, words, threshold):
    """Fronts of all different sets as blocks: part, shingles, set keys (binary)."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def packed(shingles, keys):
        h, k = np.concatenate(shingles), np.concatenate(keys)
        part = (mix(h) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, k, part = h[order], k[order], part[order]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[at[1:], len(part)]
        return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array([h[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()), pa.array([k[i:j].tobytes() for i, j in zip(at, ends)], pa.binary())], names=["part", "shingles", "keys"])

    def run(batches):
        common.claim()
        ranks, seen, shingles, keys, held = shared.value, set(), [], [], 0
        for b in common.slices(batches, 2048):
            for _, s in _sets(b, words):
                key = set_key(digest(s)) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                shingles.append(front(s, ranks, threshold))
                keys.append(np.full(len(shingles[-1]), key, np.int64))
                held += len(keys[-1])
                if held >= FRONT_ROWS:
                    yield packed(shingles, keys)
                    shingles, keys, held = [], [], 0
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
        if held:
            yield packed(shingles, keys)

    return docs.mapInArrow(run, "part long, shingles binary, keys binary")


def _shared_rows(fronts, parts):
    """(shingle, key) for shingles at the front of two different sets at least."""

    def run(batches):
        common.claim()
        blocks = {}
        for b in batches:
            for p, h, k in zip(*(b.column(c).to_pylist() for c in ("part", "shingles", "keys"))):
                blocks.setdefault(p, []).append((h, k))
        for rows in blocks.values():
            h = np.concatenate([np.frombuffer(a, np.int64) for a, _ in rows])
            k = np.concatenate([np.frombuffer(b, np.int64) for _, b in rows])
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
            h, k = h[new], k[new]
            again = np.r_[False, h[1:] == h[:-1]]
            several = again | np.r_[again[1:], False]
            yield pa.RecordBatch.from_arrays([pa.array(h[several]), pa.array(k[several])], names=["shingle", "key"])

    return fronts.repartition(parts, "part").mapInArrow(run, "shingle long, key long")


def _core(shared, sizes, threshold):
    """Leave out sets with too few shared shingles, twice: a partner's absence can
    leave another set with too few. Adds the set's size n and the shingle's count c."""
    shared = shared.join(sizes, "key")
    for _ in range(2):
        # the partner may be smaller, then it asks for less
        least = F.lit(1) + F.floor(F.ceil(F.col("n") * threshold[0] / threshold[1]) / SHARE)
        enough = shared.groupBy("key").agg(F.count("*").alias("got"), F.first("n").alias("n")).filter(F.col("got") >= least).select("key")
        left = shared.select("shingle", "key", "n").join(enough, "key", "left_semi")
        several = left.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
        shared = common.staged(left.join(several, "shingle").select("shingle", "key", "n", "c"))
    return shared


def _candidates(core, threshold):
    """Pairs (u, v) of sets that share enough front shingles, or a chain of such pairs.

    Shingles of few sets give pairs, which are counted. For those of many sets (their
    number is `wide` for a set) a pair is only allowed the smaller `wide`; if that alone
    could be enough, the sets with so many are strung to the least one of the shingle."""
    wide = core.filter(F.col("c") > FEW).groupBy("key").agg(F.count("*").alias("wide"))
    asked = 1 + F.floor(F.col("n") / SHARE)
    few = core.filter(F.col("c") <= FEW).groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("sets"))
    # by size, so the second of a pair is the larger
    pairs = F.flatten(F.transform("sets", lambda x, i: F.transform(F.filter(F.slice(F.col("sets"), i + 2, F.size("sets")), lambda y: y["n"] * threshold[0] <= x["n"] * threshold[1]), lambda y: F.struct(x["key"].alias("u"), y["key"].alias("v"), x["n"].alias("n")))))
    counted = few.select(F.explode(pairs).alias("p")).groupBy("p.u", "p.v", "p.n").agg(F.count("*").alias("both"))
    known = counted.join(wide.select(F.col("key").alias("u"), F.col("wide").alias("wide_u")), "u", "left").join(wide.select(F.col("key").alias("v"), F.col("wide").alias("wide_v")), "v", "left")
    enough = known.filter(F.col("both") + F.coalesce(F.least("wide_u", "wide_v"), F.lit(0)) * (F.col("wide_u").isNotNull() & F.col("wide_v").isNotNull()).cast("int") >= asked).select("u", "v")
    smaller = F.floor(F.ceil(F.col("n") * threshold[0] / threshold[1]) / SHARE)
    many = core.filter(F.col("c") > FEW).join(wide, "key").filter(F.col("wide") >= 1 + smaller).select("shingle", "key")
    least = many.groupBy("shingle").agg(F.min("key").alias("least"))
    strung = many.join(least, "shingle").filter("key <> least").select(F.col("least").alias("u"), F.col("key").alias("v")).distinct()
    return enough.union(strung)


def _band(n):
    return F.floor(F.log(n) / F.log(F.lit(4 / 3))).cast("int")


def _tiles(sets):
    """Every set with the tiles it belongs to: columns first (family, band, block) and
    second, both sides of a tile in order; and on which side the set is."""
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SETS), F.floor(F.lit(BLOCK_SHINGLES) / F.col("n"))))
    counts = sets.groupBy("family", "band").agg(F.ceil(F.sum(1 / per)).cast("int").alias("blocks"))
    rows = sets.join(counts, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    above = counts.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = counts.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    rows = rows.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left")
    tile = lambda band, a, band2, b: F.struct(band.alias("band"), a.alias("a"), band2.alias("band2"), b.alias("b"))
    band, block = F.col("band"), F.col("block")
    others = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.expr("cast(array() as array<struct<band:int,a:int,band2:int,b:int>>)")
    own = F.transform(others(F.col("blocks")), lambda j: tile(band, F.least(block, j), band, F.greatest(block, j)))
    up = F.when(F.col("up").isNotNull(), F.transform(others(F.col("up")), lambda j: tile(band, block, band + 1, j))).otherwise(none)
    down = F.when(F.col("down").isNotNull(), F.transform(others(F.col("down")), lambda j: tile(band - 1, j, band, block))).otherwise(none)
    return rows.select("key", "rep", "n", "family", "band", "block", F.explode(F.concat(own, up, down)).alias("tile"))


def bitmaps(sets, bits):
    """One row of bits per set."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets):
        at = s & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def links(sets, sides, threshold=THRESHOLD):
    """A spanning forest of the linked pairs (i, j) of a tile. sides: 1 and 2, or 3 for
    a tile of one block with itself; only pairs across sides are looked at."""
    n = np.array([len(s) for s in sets])
    t, of = threshold
    bits = 1 << int(max(64, 8 * n.max()) - 1).bit_length()
    signatures = bitmaps(sets, min(bits, 1 << 16))
    parent = np.arange(len(sets))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, roots = [], np.arange(len(sets))
    for i in range(len(sets)):
        other = sides != sides[i] if sides[i] != 3 else np.arange(len(sets)) > i
        if sides[i] == 2:
            continue
        j = np.flatnonzero(other & (roots != roots[i]) & (t * np.maximum(n, n[i]) <= of * np.minimum(n, n[i])))
        if not len(j):
            continue
        mine, theirs = signatures[i], signatures[j]
        most = np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
        j = j[of * most >= t * (n[i] + n[j] - most)]
        for k in j.tolist():
            if roots[k] == roots[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if of * both >= t * (n[i] + n[k] - both):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
                roots[roots == roots[k]] = roots[i]
                out.append((i, k))
    return out


def _compare(tiles, threshold):
    """Linked pairs (u, v) of representatives in every tile."""

    def run(table):
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        got = links(sets, np.array(table.column("side").to_pylist()), threshold)
        rep = table.column("rep")
        return pa.table({"u": rep.take(pa.array([i for i, _ in got], pa.int64())), "v": rep.take(pa.array([j for _, j in got], pa.int64()))})

    kind = tiles.schema["rep"].dataType.simpleString()
    return tiles.groupBy("family", "tile").applyInArrow(run, f"u {kind}, v {kind}")


def _fetch(docs, wanted, words):
    """The sets of the wanted ids, from their texts: rep, shingles."""
    few = wanted.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("_id") == F.col("rep"), "left_semi")
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        common.claim()
        for b in batches:
            ids = b.column("_id")
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([s.tobytes() for _, s in _sets(part, words)], pa.binary())], names=["rep", "shingles"])

    return texts.mapInArrow(run, f"rep {kind}, shingles binary").dropDuplicates(["rep"])


def join(df: DataFrame, threshold=THRESHOLD, words=WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id (the smallest id reached by
    links, its own included). threshold: Jaccard as a fraction (part, whole)."""
    common.ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = _measure(docs, words)
    heavy = _heavy(measured)
    rows = measured.filter("chunk is null").select("_id", "n", "digest")
    reps = common.staged(rows.filter("n > 0 and _id is not null").groupBy("digest").agg(F.min("_id").alias("rep"), F.first("n").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // (3 * FRONT_ROWS)))

    def keyed(batches):
        for b in batches:
            keys = pa.array([set_key(d) for d in b.column("digest").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, b.column("rep"), b.column("n")], names=["key", "rep", "n"])

    known = reps.mapInArrow(keyed, f"key long, rep {docs.schema['_id'].dataType.simpleString()}, n long")
    sizes = known.groupBy("key").agg(F.min("n").alias("n"))
    shared = _core(common.staged(_shared_rows(_fronts(docs, heavy, parts, words, threshold), parts)), sizes, threshold)
    families = graph.components(_candidates(shared, threshold))
    members = common.staged(families.join(known, F.col("node") == F.col("key")).select("key", "rep", "n", F.col("component").alias("family"), _band(F.col("n")).alias("band")))
    tiled = _tiles(members)
    side = F.when((F.col("tile.band") == F.col("tile.band2")) & (F.col("tile.a") == F.col("tile.b")), 3).when((F.col("band") == F.col("tile.band")) & (F.col("block") == F.col("tile.a")), 1).otherwise(2)
    full = tiled.select("rep", "family", "tile", side.alias("side")).join(_fetch(docs, members.select("rep"), words), "rep")
    linked = graph.components(_compare(full, threshold))
    classes = reps.join(linked, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(classes, "digest", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), None).otherwise(F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("_id"))).alias("component_id"))
