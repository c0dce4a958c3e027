"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are sequences of lower-case words of letters and digits. An
item of m words may differ from a passage by k = floor(m * error_rate) word edits.
Cut into k + 1 pieces, at least one piece stands unchanged in any such passage, so
an Aho-Corasick automaton over all pieces finds every place worth a look. Around
each hit Myers' bit-parallel algorithm computes the edit distance exactly.

The benchmark is the stated query set: its size is measured, and it is searched in
blocks of at most BLOCK_BYTES, so what a task holds does not grow with it.

Defined cases: null and empty texts match nothing, and an item without words is
found nowhere; items of fewer than 1 / error_rate words match exactly; repeated
items and repeated documents each give their rows; a null id is kept; other columns
are not looked at; an empty table on either side gives an empty table.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexfleet.llm import common

ERROR_RATE = 0.2
BLOCK_BYTES = 16 << 20
NOT_WORD = re.compile(r"[\W_]+")


def normal(text):
    """Words of a text, each between single spaces."""
    return f" {NOT_WORD.sub(' ', text.lower()).strip()} " if text else "  "


def pieces(words, budget):
    """Cut into budget + 1 pieces of nearly equal length: (offset, words)."""
    n, out, at = budget + 1, [], 0
    for i in range(n):
        size = (len(words) - at) // (n - i)
        out.append((at, words[at : at + size]))
        at += size
    return out


def myers(pattern, text, budget):
    """Least edit distance of `pattern` to any part of `text`, if at most `budget`, and
    the end of the first such part: (distance, end), else None."""
    m, masks = len(pattern), {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for end, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(horizontal | up)) & full, up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = (minus | ~(vertical | plus)) & full, plus & vertical
        if score <= budget and (best is None or score < best[0]):
            best = score, end
    return best


class Matcher:
    """Finds test items in texts. items: (item id, text)."""

    def __init__(self, items, error_rate):
        import ahocorasick

        self.items, by_piece = [], {}
        for item, text in items:
            words = normal(text).split()
            if not words:
                continue
            budget = int(len(words) * error_rate)
            k = len(self.items)
            self.items.append((item, words, words[::-1], budget))
            for at, part in pieces(words, budget):
                by_piece.setdefault(f" {' '.join(part)} ", []).append((k, at))
        self.automaton = None
        if by_piece:
            self.automaton = ahocorasick.Automaton()
            for p, where in by_piece.items():
                self.automaton.add_word(p, (len(p), where))
            self.automaton.make_automaton()

    def find(self, text):
        """(item id, words, budget, distance, first word, last word) for each item, its
        best passage and the first of equal ones."""
        if self.automaton is None or not text:
            return []
        line, best, seen = normal(text), {}, set()
        words = counted = None
        for end, (length, where) in self.automaton.iter(line):
            if words is None:
                words, counted, upto = line.split(), 0, 0
            start = end - length + 1
            counted += line.count(" ", upto, start) if start > upto else -line.count(" ", start, upto)
            upto = start
            for k, at in where:
                item, pattern, backward, budget = self.items[k]
                first = counted - at  # where the item would begin without edits
                if (k, first) in seen:
                    continue
                seen.add((k, first))
                lo = max(0, first - budget)
                got = myers(pattern, words[lo : first + len(pattern) + budget], budget)
                if got is None:
                    continue
                distance, stop = got[0], lo + got[1]
                back = myers(backward, words[max(0, stop - len(pattern) - budget) : stop][::-1], distance)
                found = (distance, stop - back[1], stop - 1)
                if k not in best or found < best[k]:
                    best[k] = found
        return [(self.items[k][0], len(self.items[k][1]), self.items[k][3], *v) for k, v in sorted(best.items())]


def blocks(bench: DataFrame, item_col="item_id", text_col="text", block_bytes=BLOCK_BYTES):
    """The test items as lists of at most about `block_bytes` each."""
    rows = bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        got = part.toArrow()
        yield sorted(zip(got.column("item").to_pylist(), got.column("text").to_pylist()), key=repr)


def leaks(docs: DataFrame, bench: DataFrame, error_rate=ERROR_RATE, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """One row per document and test item found in it: id, item id, n_words, budget,
    distance, first_word and last_word of the passage (words from 0)."""
    spark = docs.sparkSession
    common.ship(spark)
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (bench, item_col)))
    names = [id_col, item_col, "n_words", "budget", "distance", "first_word", "last_word"]
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type}, n_words long, budget long, distance long, first_word long, last_word long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def search(shared):
        def run(batches):
            common.claim()
            items, item_kind = shared.value
            matcher = Matcher(items, error_rate)
            for b in common.slices(batches):
                ids = b.column("_id")
                out = [(k, *hit) for k, t in enumerate(b.column("_text").to_pylist()) for hit in matcher.find(t)]
                cols = list(zip(*out)) if out else [()] * 7
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_kind), *(pa.array(c, pa.int64()) for c in cols[2:])], names=names)

        return rows.mapInArrow(run, schema)

    kind = pa.string() if item_type == "string" else pa.int32() if item_type == "int" else pa.int64()
    out = None
    for items in blocks(bench, item_col, item_text, block_bytes):
        part = search(spark.sparkContext.broadcast((items, kind)))
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, bench: DataFrame, error_rate=ERROR_RATE, text_col="text", item_col="item_id", item_text="text", block_bytes=BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` whose text holds no test item, with all their columns. No join
    and no shuffle: each block of test items is one pass over what the last one left."""
    spark = docs.sparkSession
    common.ship(spark)

    def drop(rows, shared):
        def run(batches):
            common.claim()
            matcher = Matcher(shared.value, error_rate)
            for b in common.slices(batches):
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(text_col).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for items in blocks(bench, item_col, item_text, block_bytes):
        docs = drop(docs, spark.sparkContext.broadcast(items))
    return docs
