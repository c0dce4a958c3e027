"""Vector bin packing of tokenized examples into training sequences.

Every example is a vector: tokens, one segment, loss-bearing tokens. A sequence is
filled by repeatedly adding the open example with the largest dot product between
its share of the limits and the sequence's free share, as long as one fits under
all limits at once. When none fits, documents may be cut: the example with the
largest dot product gives the piece that fills the sequence, its rest stays open.

Each task packs its own rows with a bounded pool, so nothing is shuffled and no
sequence depends on another task. What a task has left at its end, less than one
sequence, goes into sequences of decreasing powers of two, which need no padding.

Defined cases: a null or empty text has only its closing id; a null id is kept; of
repeated rows each is packed; other columns are not looked at; an empty table gives
an empty table.
"""

import os
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common

VOCABULARY = "word_bpe_49k.json"
CLOSING_ID = 2
POOL = 1024  # open examples per task
CACHED_WORDS = 550_000  # per Python worker, in two halves; a full half takes the other's place


def _byte_letters():
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def id_bytes(ids):
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordEncoder:
    """Ids of texts, one word between spaces or line ends at a time: no token of this
    vocabulary reaches over white space, so a text's ids are those of its words in
    order. Words made of letters that no normalisation changes, with marks behind,
    go to the library's model at once; all others through its whole chain."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if unicodedata.category(chr(c)) in ("Lu", "Ll") and len(chr(c).lower()) == 1]
        spelt = _byte_letters()
        self.spelling = {ord(c): "".join(spelt[b] for b in c.lower().encode()) for c in letters}
        self.letters, self.marks = frozenset(letters), ".,!?;:"
        self.words, self.older, self.parts = {}, {}, {}
        self.four = [id_bytes([i]) for i in range(max(self.tokenizer.get_vocab().values()) + 1)]

    def _part(self, part):
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHED_WORDS // 2:
                self.parts.clear()
            ids = self.parts[part] = b"".join([self.four[t.id] for t in self.model.tokenize(part)])
        return ids

    def learn(self, words):
        """The ids of a list of different words, from the cache or made now."""
        known, older = self.words, self.older
        held = list(map(known.get, words))
        new = [w for w, i in zip(words, held) if i is None]
        if len(known) + len(new) > CACHED_WORDS // 2:  # words still in use move over
            self.older = older = known
            self.words = known = {w: i for w, i in zip(words, held) if i is not None}
        hard, letters, marks, spelling, part = [], self.letters, self.marks, self.spelling, self._part
        for w in new:
            if w in older:
                known[w] = older[w]
                continue
            stem = w.rstrip(marks)
            if stem and letters.issuperset(stem):
                ids = part(stem.lower() if stem.isascii() else stem.translate(spelling))
                known[w] = ids + part(w[len(stem) :]) if len(stem) < len(w) else ids
            else:
                hard.append(w)
        for lo, hi in common.steps(hard):
            for w, e in zip(hard[lo:hi], self.tokenizer.encode_batch_fast(hard[lo:hi], add_special_tokens=False)):
                known[w] = id_bytes(e.ids)
        return [known[w] if i is None else i for w, i in zip(words, held)] if new else held

    def encode(self, texts):
        """The ids of each text as little-endian unsigned 32-bit numbers. Only the
        different words of `texts` become Python strings; their ids are put in the
        places of all words at once."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array([t.replace("\n", " ") if t else "" for t in texts], pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        ids = self.learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        of_word = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes = coded.indices.to_numpy()
        ends = np.r_[0, np.cumsum(sizes[codes])]
        ahead = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        out = of_word[np.repeat(ahead, sizes[codes]) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]


@common.kept
def encoder(path):
    return WordEncoder(path)


class DotProductPacker:
    """Packs examples (key, tokens, loss-bearing tokens) under three limits.

    `add` and `finish` yield (key, start, length, sequence, offset). With `cut` an
    example may be split anywhere; without, one that exceeds a limit raises. `unlossed`
    tokens at an example's start bear no loss."""

    def __init__(self, tokens, segments, loss, cut=True, pool=POOL):
        self.limits, self.cut, self.pool = np.array([tokens, segments, loss], float), cut, pool
        self.keys, self.starts, self.sizes = [], [], np.zeros((0, 3))
        self.n = 0
        self._open()

    def _open(self):
        self.free, self.bin = self.limits.copy(), []

    def _place(self, key, start, size, take):
        self.bin.append((key, start, int(take)))
        self.free -= (take, 1, min(size, take))

    def _close(self):
        offset = 0
        for key, start, length in self.bin:
            yield key, start, length, self.n, offset
            offset += length
        if self.bin:
            self.n += 1
        self._open()

    def add(self, examples):
        """examples: (key, tokens, loss-bearing tokens) in order."""
        keys, starts, sizes = [], [], []
        whole = int(self.limits[0])
        for key, tokens, loss in examples:
            start = 0
            if not self.cut:
                if tokens > self.limits[0] or loss > self.limits[2]:
                    raise ValueError(f"example {key} has {tokens} tokens, {loss} with loss: over the limits")
            elif self.limits[2] >= whole:
                while tokens - start >= whole:  # fills a sequence alone
                    yield key, start, whole, self.n, 0
                    self.n += 1
                    start += whole
            if tokens > start:
                keys.append(key)
                starts.append(start)
                sizes.append((tokens - start, 1, min(loss, tokens - start)))
        for i in range(0, len(keys), self.pool):
            self.keys += keys[i : i + self.pool]
            self.starts += starts[i : i + self.pool]
            self.sizes = np.concatenate([self.sizes, np.array(sizes[i : i + self.pool], float).reshape(-1, 3)])
            yield from self._pack(self.pool)

    def _pack(self, keep):
        """Close sequences until at most `keep` examples are open."""
        alive = np.ones(len(self.keys), bool)
        left = len(self.keys)
        shares = self.sizes / self.limits
        tokens, segments, loss = self.sizes.T.copy()  # a column at a time costs a fraction
        while left > keep:
            fits = alive & (tokens <= self.free[0]) & (segments <= self.free[1]) & (loss <= self.free[2])
            gain = shares @ (self.free / self.limits)
            if fits.any():
                i = int(np.argmax(np.where(fits, gain, -1.0)))
                self._place(self.keys[i], self.starts[i], self.sizes[i, 2], self.sizes[i, 0])
                alive[i] = False
                left -= 1
                continue
            take = int(min(self.free[0], self.free[2]))
            if self.cut and take > 0 and self.free[1] >= 1:
                i = int(np.argmax(np.where(alive & (tokens > take), gain, -1.0)))
                if alive[i] and self.sizes[i, 0] > take:
                    self._place(self.keys[i], self.starts[i], take, take)
                    self.starts[i] += take
                    self.sizes[i, 0] -= take
                    self.sizes[i, 2] = min(self.sizes[i, 2], self.sizes[i, 0])
                    tokens[i], _, loss[i] = self.sizes[i]
                    shares[i] = self.sizes[i] / self.limits
            yield from self._close()
        self.keys = [k for k, a in zip(self.keys, alive) if a]
        self.starts = [s for s, a in zip(self.starts, alive) if a]
        self.sizes = self.sizes[alive]

    def finish(self):
        yield from self._pack(0)
        if not self.cut:
            yield from self._close()
            return
        rest, self.bin = self.bin, []
        total = sum(length for _, _, length in rest)
        while total:
            room = size = 1 << (total.bit_length() - 1)
            offset = 0
            while room:
                key, start, length = rest.pop(0)
                take = min(room, length)
                yield key, start, take, self.n, offset
                if take < length:
                    rest.insert(0, (key, start + take, length - take))
                offset += take
                room -= take
            self.n += 1
            total -= size


def sequence_base():
    """First sequence id of this task: its partition number in the high bits."""
    return TaskContext.get().partitionId() << 32


def pack_documents(df: DataFrame, tokens=4096, segments=1024, loss=4096, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, closing_id=CLOSING_ID) -> DataFrame:
    """Tokenize texts, close each with `closing_id`, and pack them. One row per piece:
    id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens. All
    tokens but a document's first bear loss."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"

    def run(batches):
        common.claim(encoder)
        enc, packer, base = encoder(common.tokenizer_path(vocabulary)), DotProductPacker(tokens, segments, loss), sequence_base()
        end, docs, n_docs = np.array([closing_id], "<u4").tobytes(), {}, 0

        def rows(pieces):
            pieces = list(pieces)
            ids = pa.array([docs[k][0] for k, *_ in pieces], id_type)
            cols = [[s for _, s, *_ in pieces], [n for _, _, n, *_ in pieces], [zlib.crc32(docs[k][1][4 * s : 4 * (s + n)]) for k, s, n, *_ in pieces],
                    [len(docs[k][1]) // 4 for k, *_ in pieces], [base + q for *_, q, _ in pieces], [o for *_, o in pieces], [n - (s == 0) for _, s, n, *_ in pieces]]
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        id_type = None
        for b in common.slices(batches):
            id_type = b.column("_id").type
            keys, texts = b.column("_id").to_pylist(), b.column("_text").to_pylist()
            for lo, hi in common.steps(texts):
                new = []
                for key, ids in zip(keys[lo:hi], enc.encode(texts[lo:hi])):
                    docs[n_docs] = (key, ids + end)
                    new.append((n_docs, len(ids) // 4 + 1, len(ids) // 4))
                    n_docs += 1
                yield rows(packer.add(new))
                still = {*packer.keys, *(k for k, _, _ in packer.bin)}
                for k in [k for k in docs if k not in still]:
                    del docs[k]
        if id_type is not None:
            yield rows(packer.finish())

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pack_examples(df: DataFrame, tokens: int, segments: int, loss: int, id_col: str, tokens_col: str, loss_col: str) -> DataFrame:
    """Pack instruction examples that must stay whole: id, length, sequence_id, offset.
    Examples without tokens (or with a null count) take no place and give no row; one
    that exceeds a limit alone ends the job with its id."""
    common.ship(df.sparkSession)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, length long, sequence_id long, offset long"

    def run(batches):
        packer, base, id_type = DotProductPacker(tokens, segments, loss, cut=False), sequence_base(), None

        def rows(pieces):
            pieces = list(pieces)
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pieces], id_type), pa.array([p[2] for p in pieces], pa.int64()), pa.array([base + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64())],
                names=[id_col, "length", "sequence_id", "offset"])

        for b in batches:
            id_type = b.column("_id").type
            yield rows(packer.add(zip(*(b.column(c).to_pylist() for c in ("_id", "_tokens", "_loss")))))
        if id_type is not None:
            yield rows(packer.finish())

    some = df.filter(F.col(tokens_col) > 0)
    return some.select(F.col(id_col).alias("_id"), F.col(tokens_col).cast("long").alias("_tokens"), F.coalesce(F.col(loss_col), F.lit(0)).cast("long").alias("_loss")).mapInArrow(run, schema)
