"""Exact substring deduplication by distributed difference-cover suffix sorting.

Every byte covered by a `window`-byte string that also starts anywhere else is
removed. Equal windows must meet in one task, so each window gets a key that its
bytes alone decide: the least hash of its `GRAM`-byte parts. Neighbouring windows
with one key are one piece of text, named by its hash.

1. A piece that stands alone under its key has no equal window anywhere else; pieces
   with one name are equal, so all their windows repeat. Both are settled by names.
2. The texts of the other pieces (those that share a key without being equal, or hold
   their least part twice) are dealt by key. A task sorts all their suffixes by the
   difference cover modulo 3: sampled triples are sorted and named, the names are
   sorted recursively, the remaining suffixes are merged in by their first letters and
   the rank behind, and adjacent suffixes are compared on `window` bytes.

Hot keys: equal pieces of one Arrow batch are sent once; the windows of a key with
over HOT pieces, or over SORT_BYTES of them, are dealt one by one by their whole bytes.
Memory: a task holds one part of the pieces at a time, and of the texts what one sort
takes. Equal windows of a key are sorted twice at most; more of them repeat like those
two and are neither sent with their text nor held.

Defined cases: null and empty texts, and texts under `window` bytes, lose nothing by
themselves and never match; repeated rows and rows with one id are copies of each
other, each gives its row; a null id is kept; other columns are not looked at; an
empty table gives an empty table.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common
from lexfleet.llm.ngram_join import mix

WINDOW = 200
GRAM = 48
STEP = 2 << 20  # bytes that are hashed at once
PART_BYTES = 16 << 20  # of packed pieces or of texts for a task
HOT = 4096
SORT_BYTES = 2 << 20  # texts that one suffix sort takes, unless one piece is longer
ROWS = 20_000  # rows that a step hands on at a time
BASE = 0x9E3779B97F4A7C15 | 1


def suffix_array(s):
    """Suffix order of an array of numbers from 1 on, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    extra = n % 3 == 1  # an empty sampled suffix keeps the two halves apart
    at = np.arange(n + extra)
    one, two, zero = at[at % 3 == 1], at[at % 3 == 2], np.arange(0, n, 3)
    cover = np.concatenate([one, two])
    most = int(t.max()) + 1
    if most < 1 << 20:
        triples = (t[cover] * most + t[cover + 1]) * most + t[cover + 2]
        order = np.argsort(triples, kind="stable")
        new = np.r_[True, np.diff(triples[order]) != 0]
    else:
        order = np.lexsort((t[cover + 2], t[cover + 1], t[cover]))
        o = cover[order]
        new = np.r_[True, (np.diff(t[o]) != 0) | (np.diff(t[o + 1]) != 0) | (np.diff(t[o + 2]) != 0)]
    names = np.empty(len(cover), np.int64)
    names[order] = np.cumsum(new)
    sampled = cover[order] if new.all() else cover[suffix_array(names)]
    rank = np.zeros(n + 4, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    wide = n + 4
    first = t[zero] * wide + rank[zero + 1]
    by = np.argsort(first, kind="stable")
    zero, first = zero[by], first[by]
    # remaining suffixes against sampled ones: one letter and a rank, or two letters and a rank
    is_one = sampled % 3 == 1
    a, b = sampled[is_one], sampled[~is_one]
    key_a = t[a] * wide + rank[a + 1]
    pairs = np.concatenate([t[zero] * most + t[zero + 1], t[b] * most + t[b + 1]])
    pairs = np.unique(pairs, return_inverse=True)[1] * wide
    key_zero, key_b = pairs[: len(zero)] + rank[zero + 2], pairs[len(zero) :] + rank[b + 2]
    before = np.empty(len(sampled), np.int64)
    before[is_one], before[~is_one] = np.searchsorted(first, key_a), np.searchsorted(key_zero, key_b)
    out = np.empty(n, np.int64)
    out[np.arange(len(sampled)) + before] = sampled
    out[np.arange(len(zero)) + np.searchsorted(key_a, first) + np.searchsorted(key_b, key_zero)] = zero
    return out


def repeated(pieces, window):
    """For each piece (bytes) which of its windows, by start, another window of any of
    the pieces equals."""
    joined = np.frombuffer(b"\0".join([*pieces, b"\0" * (window + 8)]), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    letters = joined[: ends[-1]].astype(np.int64) + 2
    letters[ends - 1] = 1
    order = suffix_array(letters)
    piece = np.searchsorted(ends, order, side="right")
    order = order[order + window < ends[piece]]  # whole windows
    words = np.zeros(len(joined) - 8, np.uint64)
    for k in range(8):
        words |= joined[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    same = np.arange(len(order) - 1)
    for k in [*range(0, window - 7, 8), max(0, window - 8)]:
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    hit = np.zeros(len(joined), bool)
    hit[order[same]] = True
    hit[order[same + 1]] = True
    return [hit[e - len(p) - 1 : max(e - len(p) - 1, e - window)] for p, e in zip(pieces, ends)]


@common.kept
def _powers(n):
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)])
    return up, down


def _slide(x, width, take):
    """take (minimum or maximum) of every `width` neighbours."""
    done = 1
    while done < width:
        k = min(done, width - done)
        x = take(x[: len(x) - k], x[k:])
        done += k
    return x


class Pieces:
    """Pieces of some texts (bytes): arrays doc, start, count (windows), key, name, twice
    (the least part occurs twice, so windows of the piece may equal each other)."""

    def __init__(self, texts, window=WINDOW):
        gram = min(GRAM, window)
        room = window - gram + 1
        x = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        empty = np.zeros(0, np.int64)
        self.doc = self.start = self.count = empty
        self.key = self.name = empty.astype(np.uint64)
        self.twice = empty.astype(bool)
        if len(x) < window or not (sizes >= window).any():
            return
        up, down = _powers(1 << int(max(STEP, len(x))).bit_length())
        sums = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])])
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1]) | np.uint64(1)
        least = _slide(h, room, np.minimum)  # by window start
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
        valid = np.arange(len(least)) + window <= (starts + sizes)[doc]
        least = np.where(valid, least, np.uint64(0))
        edge = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
        a = np.flatnonzero(edge)
        n = np.diff(np.r_[a, len(least)])
        a, n = a[valid[a]], n[valid[a]]
        self.doc, self.start, self.count, self.key = doc[a], a - starts[doc[a]], n, least[a]
        size = n + window - 1
        self.name = mix((sums[a + size] - sums[a]) * down[a] + size.astype(np.uint64))
        self.twice = np.zeros(len(a), bool)
        chosen = _slide(np.concatenate([np.zeros(room - 1, np.uint64), least, np.zeros(room - 1, np.uint64)]), room, np.maximum)
        chosen = np.flatnonzero(chosen[: len(h)] == h)
        if len(chosen) != len(a):
            # count the least parts inside each piece
            lo, hi = np.searchsorted(chosen, a), np.searchsorted(chosen, a + n + room - 1)
            for k in np.flatnonzero(hi - lo > 1):
                self.twice[k] = (h[chosen[lo[k] : hi[k]]] == self.key[k]).sum() > 1


def _packed(part, columns):
    """Rows sorted into parts: (part, one bytes object per column) each."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(part)]
    return [pa.array(part[at], pa.int64()), *(pa.array([c[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for c in columns)]


PIECE = np.dtype([("key", "<u8"), ("name", "<u8"), ("text", "V16"), ("start", "<i4"), ("count", "<i4"), ("mark", "u1")])
SURE, TWICE = 1, 2  # marks: repeats for certain; may repeat within itself


def _records(batch, window):
    """The pieces of the different texts of an Arrow batch, equal pieces marked."""
    first, again, texts = {}, set(), batch.column("text").to_pylist()
    for t, d in zip(texts, batch.column("digest").to_pylist()):
        if t is not None and len(t) >= window:
            if d in first:
                again.add(d)
            else:
                first[d] = t
    out, items = [], list(first.items())
    for lo, hi in common.steps([t for _, t in items], STEP):
        p = Pieces([t for _, t in items[lo:hi]], window)
        r = np.zeros(len(p.doc), PIECE)
        digests = np.array([d for d, _ in items[lo:hi]], "V16")
        r["key"], r["name"], r["text"], r["start"], r["count"] = p.key, p.name, digests[p.doc], p.start, p.count
        sure = np.array([d in again for d, _ in items[lo:hi]])[p.doc]
        r["mark"] = sure * SURE + p.twice * TWICE
        out.append(r)
    r = np.concatenate(out) if out else np.zeros(0, PIECE)
    order = np.lexsort((r["name"], r["key"]))
    r = r[order]
    same = (r["key"][1:] == r["key"][:-1]) & (r["name"][1:] == r["name"][:-1])
    r["mark"] |= (np.r_[False, same] | np.r_[same, False]).astype(np.uint8) * SURE if len(r) else 0
    return r, np.r_[True, ~same] if len(r) else np.zeros(0, bool)


def _deal(docs, parts, window):
    def run(batches):
        common.claim(_powers)
        for b in batches:
            r, lead = _records(b, window)
            # one of equal pieces goes to its key; the others are settled and go anywhere
            part = np.where(lead, mix(r["key"]) % np.uint64(parts), mix(r["name"] + r["start"].astype(np.uint64) + np.ascontiguousarray(r["text"]).view("<u8")[::2]) % np.uint64(parts)).astype(np.int64)
            for settled in (False, True):
                some = ~lead if settled else lead
                cols = _packed(part[some], [r[some]])
                yield pa.RecordBatch.from_arrays([*cols, pa.array([settled] * len(cols[0]), pa.bool_())], names=["part", "pieces", "settled"])

    return docs.mapInArrow(run, "part long, pieces binary, settled boolean")


def _settle(dealt, parts, most, window):
    """Pieces that repeat wholly (key null), and those whose texts must be sorted (their
    key, and whether over `most` different pieces, or too long ones, have it)."""

    def judged(rows):
        r = np.concatenate(rows)
        rows.clear()
        r = r[np.lexsort((r["name"], r["key"]))]
        key_new = np.r_[True, r["key"][1:] != r["key"][:-1]]
        name_new = key_new | np.r_[True, r["name"][1:] != r["name"][:-1]]
        of_key, of_name = np.cumsum(key_new) - 1, np.cumsum(name_new) - 1
        full = (np.bincount(of_name)[of_name] > 1) | (np.bincount(of_name, (r["mark"] & SURE) > 0)[of_name] > 0)
        kinds = np.bincount(of_key, name_new)
        # of equal pieces one stays to meet the others of its key
        unsure = np.where(full, name_new & (kinds[of_key] > 1), (kinds[of_key] > 1) | ((r["mark"] & TWICE) > 0))
        size = np.where(unsure, r["count"] + np.int64(window - 1), 0)
        beside = np.bincount(of_key, size) - np.maximum.reduceat(size, np.flatnonzero(key_new))  # the longest stays whole
        hot = (kinds > most) | (beside > SORT_BYTES)
        yield from _verdicts(r[full], None, None)
        yield from _verdicts(r[unsure], r["key"][unsure], hot[of_key][unsure])

    def run(batches):
        common.claim()
        # one part after the other: a partition may have several
        rows, last = [], None
        for b in batches:
            for p, raw, settled in zip(*(b.column(c).to_pylist() for c in ("part", "pieces", "settled"))):
                if settled:
                    yield from _verdicts(np.frombuffer(raw, PIECE), None, None)
                    continue
                if rows and p != last:
                    yield from judged(rows)
                rows.append(np.frombuffer(raw, PIECE))
                last = p
        if rows:
            yield from judged(rows)

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "digest binary, start int, count int, key long, hot boolean")


def _verdicts(rows, keys, hots):
    for lo in range(0, len(rows), ROWS):
        r, n = rows[lo : lo + ROWS], len(rows[lo : lo + ROWS])
        digests = pa.array([x.tobytes() for x in r["text"]], pa.binary())
        key = pa.nulls(n, pa.int64()) if keys is None else pa.array(keys[lo : lo + ROWS].astype(np.int64))
        hot = pa.nulls(n, pa.bool_()) if hots is None else pa.array(hots[lo : lo + ROWS])
        yield pa.RecordBatch.from_arrays([digests, pa.array(r["start"]), pa.array(r["count"]), key, hot], names=["digest", "start", "count", "key", "hot"])


def _texts_of(docs, open_pieces, parts, window):
    """Texts of the open pieces, packed by key: part, key, digest, start, count, text (null
    for a window that equals two others of its batch)."""
    wanted = open_pieces.groupBy("digest").agg(F.collect_set(F.struct("start", "count", "key", "hot")).alias("open"))
    # copies of a text may come twice: all that they hold repeats anyway
    texts = docs.filter("text is not null").join(wanted, "digest").select("digest", "text", "open")

    def packed(out):
        keys = np.array([k for k, *_ in out], np.int64)
        columns = [(mix(keys.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), keys, *([x[i] for x in out] for i in range(1, 5))]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "key", "digest", "start", "count", "text"])

    def run(batches):
        for b in batches:
            seen, met, out, size = set(), {}, [], 0
            for d, text, pieces in zip(*(b.column(c).to_pylist() for c in ("digest", "text", "open"))):
                if d in seen:
                    continue
                seen.add(d)
                for p in pieces:
                    start, count = p["start"], p["count"]
                    if p["hot"]:
                        for k in range(start, start + count):
                            t = text[k : k + window]
                            name = int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True)
                            first = met.setdefault(name, [t, 0])
                            if len(met) > ROWS:
                                met.clear()
                            first[1] += first[0] == t
                            out.append((name, d, k, 1, None if first[0] == t and first[1] > 2 else t))
                            size += window
                            if size > SORT_BYTES or len(out) >= ROWS:
                                yield packed(out)
                                out, size = [], 0
                    else:
                        out.append((p["key"], d, start, count, text[start : start + count + window - 1]))
                        size += count + window
                        if size > SORT_BYTES or len(out) >= ROWS:
                            yield packed(out)
                            out, size = [], 0
            if out:
                yield packed(out)

    return texts.mapInArrow(run, "part long, key long, digest binary, start int, count int, text binary")


def _sort(texts, parts, window):
    """Repeated runs of windows of the open pieces: digest, start, count."""

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["digest", "start", "count"])

    def found(group):
        out = []
        for (digest, start, _), hit in zip(group, repeated([t for _, _, t in group], window)):
            at = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            out += [(digest, start + int(i), int(j - i)) for i, j in zip(at[::2], at[1::2])]
        return rows(out)

    def run(batches):
        common.claim()
        # pieces arrive in the order of their keys; whole keys are sorted together
        group, size, own, own_size, copies, sure, last = [], 0, [], 0, {}, [], None
        for b in batches:
            for key, digest, start, count, text in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "start", "count", "text"))):
                if key != last:
                    if group and size + own_size > SORT_BYTES:
                        yield found(group)
                        group, size = [], 0
                    group += own
                    size, own, own_size, copies, last = size + own_size, [], 0, {}, key
                if text is not None:
                    copies[text] = copies.get(text, 0) + 1
                if text is None or copies[text] > 2:
                    sure.append((digest, start, count))  # two equal ones are sorted
                    if len(sure) >= ROWS:
                        yield rows(sure)
                        sure = []
                else:
                    own.append((digest, start, text))
                    own_size += len(text)
        if group and size + own_size > SORT_BYTES:
            yield found(group)
            group = []
        if group + own:
            yield found(group + own)
        if sure:
            yield rows(sure)

    return texts.repartition(parts, "part").sortWithinPartitions("key").mapInArrow(run, "digest binary, start int, count int")


def remove(df: DataFrame, window=WINDOW, hot=HOT, id_col="doc_id", text_col="text", keep_text=False) -> DataFrame:
    """One row per row of `df`: id, n_bytes, n_removed, n_spans, kept_sha256, and the
    removed spans (start, end) of bytes; with keep_text also the remaining bytes."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    raw = F.col(text_col).cast("binary")
    docs = df.select(F.col(id_col).alias("_id"), raw.alias("text"), F.unhex(F.md5(raw)).alias("digest"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(total) // (PART_BYTES * 2) + 1)
    verdicts = common.staged(_settle(_deal(docs.select("text", "digest"), parts, window), parts, hot, window))
    open_pieces = verdicts.filter("key is not null")
    sorted_runs = common.staged(_sort(_texts_of(docs.select("text", "digest"), open_pieces, parts, window), parts, window))
    spans = verdicts.filter("key is null").select("digest", "start", "count").union(sorted_runs).distinct()
    spans = spans.groupBy("digest").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if keep_text else [])]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            sizes, removed, found, digests, kept = [], [], [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                text = text or b""
                merged = []
                for s, n in sorted((r["start"], r["count"]) for r in runs or ()):
                    end = s + n - 1 + window
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([s, end])
                left, at = [], 0
                for s, e in merged:
                    left.append(text[at:s])
                    at = e
                rest = b"".join([*left, text[at:]])
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                found.append([{"start": s, "end": e} for s, e in merged])
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [b.column("_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(digests, pa.string()), pa.array(found, span_type)]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if keep_text else [])], names=names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept binary" if keep_text else "")
    return docs.join(spans, "digest", "left").select("_id", "text", "runs").mapInArrow(run, schema)
