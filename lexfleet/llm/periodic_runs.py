"""Runs of repeated words: maximal stretches with a period, by string synchronising sets.

The words of many texts stand in one array of numbers, with a number of its own behind
each text, so no stretch crosses texts. At every scale t = 4, 8, 16, ... each window of
t words has a name (a 64-bit hash, made from the names of its halves). A position is
synchronising if the least name among the t + 1 windows from it on is the first or the
last of them. That depends on the next 2t words only, so equal contexts of 2t words are
picked alike, and any t positions in a row hold one, unless the words around have a
period of t / 4 at most: such windows are left out. The last positions that two
neighbouring equal contexts start at propose their distance as a period. A run with
smallest period q, t <= q < 2t, and at least 4q words has such a pair: its first picked
position and the one q further, and no equal context starts between them.

Periods below 4 are found without names, where words equal those 1, 2 or 3 further on.
Every proposal is checked word by word and extended to both sides, so hashes decide
only where to look. The runs found so far are the highly periodic windows that later
scales leave out.

Texts are sorted by length, so a scale looks only at those with 4t words or more.

Defined cases: null and empty texts have no words and no runs; words are told apart by
their bytes; repeated rows give repeated results; a null id is kept; other columns are
not looked at; an empty table gives an empty table.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST = 6  # words of a run
TIMES = 4  # periods of a run
SMALL = 4  # periods below this are found without names
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(a, b):
    """A name for the pair of two names."""
    x = (a ^ b * np.uint64(0x9E3779B97F4A7C15)) + (b << np.uint64(31) | b >> np.uint64(33))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _least(names, width):
    """The least of every `width` names in a row, by running minima of blocks to both sides."""
    n = len(names) - width + 1
    blocks = -(-len(names) // width)
    padded = np.full(blocks * width, LAST)
    padded[: len(names)] = names
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def synchronising(names, t):
    """Positions whose window, or the one t further, has the least name of the t + 1
    windows from it on. Windows named LAST are left out."""
    if len(names) <= t:
        return np.zeros(0, np.int64)
    least = _least(names, t + 1)
    n = len(least)
    return np.flatnonzero(((least == names[:n]) | (least == names[t : t + n])) & (least != LAST))


def _same_ahead(words, a, b):
    """How many words from a on equal those from b on (a < b)."""
    done, step = 0, 32
    while b + done < len(words):
        x = words[a + done : a + done + step]
        y = words[b + done : b + done + step]
        differ = np.flatnonzero(x[: len(y)] != y)
        if len(differ):
            return done + int(differ[0])
        done += len(y)
        step = min(2 * step, 1 << 20)
    return done


def _same_behind(words, a, b):
    """How many words before a equal those before b (a < b)."""
    done, step = 0, 32
    while a - done > 0:
        lo = max(a - done - step, 0)
        x, y = words[lo : a - done], words[lo + b - a : b - done]
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + len(x) - 1 - int(differ[-1])
        done += len(x)
        step = min(2 * step, 1 << 20)
    return done


def runs_of(words, longest):
    """(start, length, period) of all runs in an array of numbers. longest(n): how long the
    front of the array is that holds all texts with n words or more."""
    found = {}  # (start, end) -> least period

    def add(start, end, q):
        if end - start >= max(LEAST, TIMES * q):
            known = found.get((start, end))
            if known is None or q < known:
                found[start, end] = q

    for q in range(1, SMALL):
        same = np.zeros(max(len(words) - q, 0) + 2, np.int8)
        same[1:-1] = words[:-q] == words[q:]
        edge = np.flatnonzero(np.diff(same))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start >= max(LEAST, TIMES * q) - q:
                add(start, end + q, q)
    names, size, t = words.astype(np.uint64), 1, SMALL
    while (front := longest(TIMES * t)) >= TIMES * t:
        words, names = words[:front], names[: max(front - size + 1, 0)]
        while size < t:
            names = _mixed(names[:-size], names[size:])
            size *= 2
        picked = names.copy()
        for (start, end), q in found.items():
            if TIMES * q <= t <= end - start and start < len(picked):
                picked[start : end - t + 1] = LAST
        places = synchronising(picked, t)
        places = places[places + 2 * t <= len(words)]
        context = _mixed(names[places], names[places + t])
        order = np.lexsort((places, context))
        places, context = places[order], context[order]
        distance = np.diff(places)
        near = np.flatnonzero((context[1:] == context[:-1]) & (distance >= t) & (distance < 2 * t))
        pairs = sorted(zip(distance[near].tolist(), places[near].tolist()))
        period, upto = 0, 0
        for q, at in pairs:
            if q == period and at + q < upto:
                continue  # in the stretch that was looked at last
            start = at - _same_behind(words, at, at + q)
            upto, period = at + q + _same_ahead(words, at, at + q), q
            add(start, upto, q)
        t *= 2
    return sorted((start, end - start, q) for (start, end), q in found.items())


def find_runs(texts):
    """For each text its words and its runs."""
    split = [WORD.findall(t) if t else [] for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    numbers, flat, starts, at = {}, [], [], 0
    for k, i in enumerate(order):
        starts.append(at)
        flat += [numbers.setdefault(w, len(numbers)) for w in split[i]]
        flat.append(-1 - k)  # ends this text, equals nothing
        at += len(split[i]) + 1
    sizes = -np.array([len(split[i]) for i in order])
    ends = np.array([*starts, at])

    def longest(n):
        return int(ends[np.searchsorted(sizes, -n, side="right")])

    out = [[] for _ in split]
    if flat:
        begins = np.array(starts)
        for start, length, q in runs_of(np.array(flat, np.int64), longest):
            k = int(np.searchsorted(begins, start, side="right")) - 1
            out[order[k]].append((start - starts[k], length, q))
    return zip(split, out)


def collapse(words, runs):
    """The words that stay when every run keeps its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def find(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of `df`: id, n_words, runs (array of start, length, period, by
    start and period), and collapsed, the words that stay, joined by one space."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        common.claim()
        for b in common.slices(batches):
            texts = b.column("_text").to_pylist()
            for lo, hi in common.steps(texts):
                n, runs, rest = [], [], []
                for words, found in find_runs(texts[lo:hi]):
                    n.append(len(words))
                    runs.append([{"start": s, "length": k, "period": q} for s, k, q in found])
                    rest.append(" ".join(collapse(words, found) if found else words))
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(runs, pa.list_(entry)), pa.array(rest, pa.string())],
                    names=[id_col, "n_words", "runs", "collapsed"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The longest of some runs (ties: least start, then period), null without one."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)
