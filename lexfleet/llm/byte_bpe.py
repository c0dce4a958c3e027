"""Byte-level BPE: texts to ids and back, by segment trees.

A text is cut by a pattern, and every piece is merged on its own. The leaves of a
segment tree stand over the piece's byte positions: the leaf of a live token's first
byte holds the rank of the pair that this token makes with its live neighbour to the
right, and every inner node the least pair of rank and position below it. The root is
thus the leftmost pair of least rank. A merge changes three leaves (the pair itself,
the neighbour it swallows, the neighbour to its left), each a path to the root, so a
piece of n bytes takes O(n log n). Many short pieces are merged at a time, one row of
a table each; long ones have a tree of their own. A piece that is a token is that
token, as in the libraries that read these rank files.

Pieces that were met before come from a bounded cache. A text is cut at places where
pieces must end, so a very long one is never held as pieces as a whole.

Defined cases: a null text counts as empty (no ids); null or empty ids decode to no
bytes; an id that the vocabulary lacks, or ids cut inside a number, end the job;
special strings are ordinary text; repeated rows give repeated results; a null id
is kept; other columns are not looked at; an empty table gives an empty table.
"""

import base64
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_PIECES = 500_000  # per Python worker; beyond it the cache starts anew
CACHED_CHARS = 64  # of a piece that is kept
TABLE_BYTES = 1024  # longest piece that shares a table; longer ones have their own tree
TABLE_CELLS = 1 << 20
FEWEST_ROWS = 16  # tables pay for so many pieces of like length
PART_CHARS = 1 << 18
NONE = np.int64(1) << 62
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path):
    """The tokens of a rank file: one line for each, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairRanks:
    """The rank of the token that two neighbouring tokens make, for many pairs at once:
    a hash table with linear probing."""

    def __init__(self, ranks):
        self.one = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.one[left, right] = rank
        bits = max(4, (4 * len(self.one)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        keys = np.array([a << 32 | b for a, b in self.one], np.int64)
        values = np.array(list(self.one.values()), np.int64)
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            slot = at[todo]
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = first & (self.keys[slot] < 0)
            self.keys[slot[take]], self.ranks[slot[take]] = keys[todo[take]], values[todo[take]]
            todo = todo[~take]
            at[todo] = at[todo] + 1 & self.mask

    def _slots(self, keys):
        return (keys.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def __call__(self, left, right):
        keys = left << 32 | right
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


def _little(ids):
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteBpe:
    def __init__(self, path, pattern):
        self.ranks = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.pairs = PairRanks(self.ranks)
        self.split = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S)\s").search
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.known = {}

    def merge_table(self, pieces):
        """Ids of pieces of 2 to TABLE_BYTES bytes, as little-endian numbers."""
        size = np.array([len(p) for p in pieces])
        width = 1 << int(size.max() - 1).bit_length()
        bits, n = width.bit_length() - 1, len(pieces)
        inside = np.arange(width) < size[:, None]
        token = np.zeros((n, width), np.int64)
        token[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        # the token to the right and to the left of each; `width` and -1 stand for none
        right = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), width)
        left = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        paired = np.zeros((n, width), bool)
        paired[:, :-1] = inside[:, 1:]
        rank = self.pairs(token[:, :-1][paired[:, :-1]], token[:, 1:][paired[:, :-1]])
        leaf = np.where(rank < NONE, rank << bits | np.broadcast_to(np.arange(width), (n, width))[paired], NONE)
        tree[:, width:][paired] = leaf
        for k in range(bits - 1, -1, -1):
            a, b = 1 << k, 2 << k
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        live = inside
        token, right, left, tree = token.ravel(), right.ravel(), left.ravel(), tree.ravel()
        flat = live.ravel()
        rows = np.arange(n)

        def put(rows, at, ranks):
            """New ranks of the pairs at some positions: leaves and the paths above them."""
            node = rows * (2 * width) + width + at
            tree[node] = np.where(ranks < NONE, ranks << bits | at, NONE)
            base, node = rows * (2 * width), at + width
            for _ in range(bits):
                child = base + (node & ~1)
                node = node >> 1
                tree[base + node] = np.minimum(tree[child], tree[child + 1])

        while True:
            top = tree[rows * (2 * width) + 1]
            some = top < NONE
            rows, top = rows[some], top[some]
            if not len(rows):
                break
            at, merged, base = top & (width - 1), top >> bits, rows * width
            gone = right[base + at]
            behind = right[base + gone]
            token[base + at] = merged
            right[base + at] = behind
            flat[base + gone] = False
            put(rows, gone, np.full(len(rows), NONE))
            has = behind < width
            left[(base + behind)[has]] = at[has]
            ranks = np.full(len(rows), NONE)
            ranks[has] = self.pairs(merged[has], token[(base + behind)[has]])
            put(rows, at, ranks)
            before = left[base + at]
            has = before >= 0
            put(rows[has], before[has], self.pairs(token[(base + before)[has]], merged[has]))
        counts = flat.reshape(n, width).sum(axis=1)
        raw = token[flat].astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts)).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *ends], ends)]

    def merge_one(self, piece):
        """The same for one piece of any length."""
        n = len(piece)
        if n < 2:
            return _little(self.of_byte[list(piece)].tolist())
        width, none, pair = 1 << (n - 1).bit_length(), int(NONE), self.pairs.one.get
        bits = width.bit_length() - 1
        token = self.of_byte[np.frombuffer(piece, np.uint8)]
        leaves = np.full(width, NONE)
        rank = self.pairs(token[:-1], token[1:])
        leaves[: n - 1] = np.where(rank < NONE, rank << bits | np.arange(n - 1), NONE)
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none] + [x for level in reversed(levels) for x in level.tolist()]
        token, right, left, live = token.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def put(at, rank):
            node = at + width
            tree[node] = none if rank is None else rank << bits | at
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        while tree[1] < none:
            at, merged = tree[1] & width - 1, tree[1] >> bits
            gone = right[at]
            behind = right[at] = right[gone]
            token[at], live[gone] = merged, 0
            put(gone, None)
            if behind < n:
                left[behind] = at
            put(at, pair((merged, token[behind])) if behind < n else None)
            if left[at] >= 0:
                put(left[at], pair((token[left[at]], merged)))
        return _little([t for t, alive in zip(token, live) if alive])

    def learn(self, pieces):
        """Make all of a set of pieces known at once; a full cache starts anew before."""
        if len(self.known) + len(pieces.difference(self.known)) > CACHED_PIECES:
            self.known = {}
        shared = {}
        for p in pieces.difference(self.known):
            raw = p.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.known[p] = _little([rank])
            else:
                shared.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for bits, some in shared.items():
            step = max(1, TABLE_CELLS >> bits)
            for lo in range(0, len(some), step):
                raws = [raw for _, raw in some[lo : lo + step]]
                few = len(raws) < FEWEST_ROWS or 1 << bits > TABLE_BYTES
                merged = map(self.merge_one, raws) if few else self.merge_table(raws)
                self.known.update(zip((p for p, _ in some[lo : lo + step]), merged))

    def parts(self, text):
        """A text in parts of about PART_CHARS characters. White space behind another
        character always starts a piece, so parts only end there."""
        start = 0
        while len(text) - start > PART_CHARS:
            found = self.cut(text, start + PART_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode(self, texts):
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        pieces, out, size = [], [], 0

        def finish():
            self.learn(set().union(*(ps for _, ps in pieces)))
            get = self.known.__getitem__
            for i, ps in pieces:
                out[i].append(b"".join(map(get, ps)))
            pieces.clear()
            for p in long:  # too long to keep
                self.known.pop(p, None)
            long.clear()

        long = set()
        for i, t in enumerate(texts):
            out.append([])
            for part in self.parts(t or ""):
                found = self.split(part)
                if found and len(max(found, key=len)) > CACHED_CHARS:
                    long.update(p for p in found if len(p) > CACHED_CHARS)
                pieces.append((i, found))
                size += len(part)
                if size >= PART_CHARS * 4:
                    finish()
                    size = 0
        finish()
        return [b"".join(parts) for parts in out]

    def decode(self, ids):
        """The bytes behind little-endian numbers."""
        numbers = array("I")
        numbers.frombytes(ids or b"")
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.tokens.__getitem__, numbers))


@common.kept
def model(path, pattern):
    return ByteBpe(path, pattern)


def _pattern(pattern):
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return pattern


def encode(df: DataFrame, text_col="text", ids_col="ids", ranks=RANKS, pattern=None, keep=("doc_id",)) -> DataFrame:
    """`keep` and the ids of every whole text: little-endian unsigned 32-bit numbers in
    one binary value. `pattern` cuts texts into pieces; without one it is the pattern
    that belongs to the public rank files."""
    return _mapped(df, text_col, ids_col, keep, ranks, pattern, lambda bpe, texts: bpe.encode(texts))


def decode(df: DataFrame, ids_col="ids", bytes_col="bytes", ranks=RANKS, pattern=None, keep=("doc_id",)) -> DataFrame:
    """`keep` and the bytes behind the ids that `encode` made."""
    return _mapped(df, ids_col, bytes_col, keep, ranks, pattern, lambda bpe, ids: map(bpe.decode, ids))


def _mapped(df, source, target, keep, ranks, pattern, fn):
    common.ship(df.sparkSession)
    pattern = _pattern(pattern)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{target}` binary"])

    def run(batches):
        common.claim(model)
        bpe = model(common.tokenizer_path(ranks), pattern)
        for b in common.slices(batches):
            values = b.column("_source").to_pylist()
            for lo, hi in common.steps(values):
                kept = [b.column(f"_keep{i}").slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fn(bpe, values[lo:hi]), pa.binary())], names=[*keep, target])

    return df.select(F.col(source).alias("_source"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep))).mapInArrow(run, schema)


def n_tokens(ids):
    """How many ids a value of `encode` holds."""
    return F.shiftright(F.octet_length(ids).cast("long"), 2)
