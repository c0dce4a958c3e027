"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is a sentencepiece BPE model whose pieces hold the space mark only
at their start, so a text falls into words that never share a token. Inside a word
the last token of every prefix is unique: it is the token that ends there and may
stand next to the last token of the prefix before it. One pass over the prefixes
therefore gives the exact count of each, and sums over words those of the whole
text. How many tokens the first n characters have, and where a budget ends, are
read off these counts without encoding again.

Defined cases: a null text counts as empty (no token); repeated rows give repeated
results; other columns of the input are not looked at; an empty table gives an
empty table.
"""

from array import array
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHED_WORDS = 2_000_000  # per Python worker, about 300 MB; beyond it the cache starts anew
CACHED_WORD_CHARS = 64
STEP = 8 << 20  # characters whose words are learned together
BASE = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 19


_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 10, BASE, np.uint64)])


def _prefix_hashes(letters):
    """Hashes of all prefixes of the rows of a table of code points."""
    out = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    for k in range(letters.shape[1]):
        out[:, k + 1] = out[:, k] * BASE + letters[:, k] + np.uint64(1)
    return out


def _slot(keys):
    return ((keys ^ keys >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _utf8_bytes(c):
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


class PrefixCounter:
    def __init__(self, path):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) or SPACE in p[1:] and p.strip(SPACE) for p in self.score):
            raise ValueError("pieces that go on after a space cannot be counted word by word")
        if m.normalize("ﬁ a  b ") != f"{SPACE}ﬁ{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("the model rewrites texts; count its normalised texts instead")
        # the longest piece that ends with some characters bounds the search for a token
        self.reach = {}
        for piece in self.score:
            end = piece[-3:]
            self.reach[end] = max(self.reach.get(end, 0), len(piece))
        self._index()
        self.pairs, self.number_pairs, self.built, self.words = {}, {}, {}, {}
        self.marks = [n for n in range(1, self.width + 1) if SPACE * n in self.score]
        self.run_ends, self.run_counts = array("I", [0]), array("I", [0])

    def _steps(self, t):
        """How BPE builds `t` from its characters (best score first, leftmost on ties):
        the score of each merge, the first and the last part before each merge and at
        the end, and whether all of `t` becomes one part."""
        known = self.built.get(t)
        if known is None:
            parts, scores, firsts, lasts = list(t), [], [t[0]], [t[-1]]
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = self.score.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self.built[t] = (scores, firsts, lasts, len(parts) == 1)
        return known

    def _follows(self, a, b):
        """Whether the tokens a and b stay apart: their merges run side by side, and
        no merge across the border comes first at any point."""
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(a, b)
        return ok

    def _apart(self, a, b):
        left, _, lasts, _ = self._steps(a)
        right, firsts, _, whole = self._steps(b)
        if not whole:
            return False
        i = j = 0
        while True:
            across = self.score.get(lasts[i] + firsts[j])
            a_next = left[i] if i < len(left) else None
            b_next = right[j] if j < len(right) else None
            if across is not None and (a_next is None or across > a_next) and (b_next is None or across >= b_next):
                return False
            if a_next is None and b_next is None:
                return True
            if b_next is None or a_next is not None and a_next >= b_next:
                i += 1
            else:
                j += 1

    def _starts(self, a):
        return self._steps(a)[3]

    def _extend(self, s, last, counts):
        """Go on from the prefixes already known to all prefixes of `s`."""
        score, reach, pairs, follows, starts = self.score, self.reach.get, self.pairs, self._follows, self._starts
        for i in range(len(last), len(s) + 1):
            longest = reach(s[i - 3 : i], 2) if i > 2 else 2
            for j in range(i - longest if i > longest else 0, i):
                t = s[j:i]
                if t in score:
                    if j:
                        ok = pairs.get((last[j], t))
                        if ok or ok is None and follows(last[j], t):
                            last.append(t)
                            counts.append(counts[j] + 1)
                            break
                    elif starts(t):
                        last.append(t)
                        counts.append(1)
                        break
                elif j == i - 1:  # a character without a piece is spelt in bytes
                    last.append(t)
                    counts.append(counts[j] + len(t.encode()))
            if len(last) != i + 1:
                raise ValueError(f"no tokens end at {i} of {s!r}")

    def prefixes(self, word):
        """Counts for every prefix of the space mark plus `word`, and whether the
        space mark stays a token of its own at the start."""
        s, last, counts = SPACE + word, [None], [0]
        self._extend(s, last, counts)
        bare = [False]
        for i in range(1, len(s) + 1):
            j = i - len(last[i])
            bare.append(bare[j] if j else last[i] == SPACE)
        return counts, bare

    def _index(self):
        """A table from the hash of a piece to its number; slots that two pieces share
        are looked up by search."""
        self.pieces = list(self.score)
        width = max(map(len, self.pieces))
        letters = np.array(self.pieces, f"U{width}").view(np.uint32).reshape(-1, width)
        size = np.array([len(p) for p in self.pieces])
        self.keys = _prefix_hashes(letters)[np.arange(len(size)), size]
        if len(np.unique(self.keys)) < len(size) or len(size) >= 65534:
            raise ValueError("pieces cannot be numbered by their hashes")
        self.by_key = np.argsort(self.keys)
        self.width, self.slots = width, np.full(1 << SLOT_BITS, 65535, np.uint16)
        slot = _slot(self.keys)
        self.slots[slot] = np.arange(len(size))
        several = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.slots[several] = 65534

    def _numbers(self, keys):
        """Numbers of the pieces with these hashes, -1 where there is none."""
        at = self.slots[_slot(keys)].astype(np.int64)
        out = np.where(at < 65534, at, 0)
        out = np.where((at < 65534) & (self.keys[out] == keys), out, -1)
        search = np.flatnonzero(at == 65534)
        if len(search):
            found = self.by_key[np.minimum(np.searchsorted(self.keys, keys[search], sorter=self.by_key), len(self.keys) - 1)]
            out[search] = np.where(self.keys[found] == keys[search], found, -1)
        return out

    def _name(self, number):
        """The token with a number: pieces first, then characters without a piece."""
        return self.pieces[number] if number < len(self.pieces) else chr(number - len(self.pieces))

    def _apart_all(self, left, right):
        """Whether tokens may stand side by side; left -1 is the start of a word."""
        wide = len(self.pieces) + 0x110000
        codes, at = np.unique((left + 1) * wide + right, return_inverse=True)
        pairs, ok = self.number_pairs, []
        if len(pairs) > 1_500_000:
            pairs.clear()
        for code in codes.tolist():
            known = pairs.get(code)
            if known is None:
                a, b = divmod(code, wide)
                known = pairs[code] = self._apart(self._name(a - 1), self._name(b)) if a else self._starts(self._name(b))
            ok.append(known)
        return np.array(ok, bool)[at]

    def learn(self, words):
        """Make all of a set of words known at once; a full cache starts anew before. Sorted,
        their different prefixes of each length are rows of one level, and a level follows
        from those before it."""
        if len(self.words) + len(words.difference(self.words)) > CACHED_WORDS:
            self.words.clear()
        plain = sorted(w for w in words.difference(self.words) if "\0" not in w)
        for lo in range(0, len(plain), 50_000):
            self._learn(plain[lo : lo + 50_000])

    def _learn(self, words):
        size = np.array([len(w) for w in words]) + 1
        letters = np.zeros((len(words), size.max()), np.uint32)
        letters[:, 0] = ord(SPACE)
        letters[:, 1:] = np.array(words, f"U{size.max() - 1}").view(np.uint32).reshape(len(words), -1)
        hashes = _prefix_hashes(letters)
        shared = np.r_[0, (letters[1:] != letters[:-1]).argmax(axis=1)]  # characters as in the word before
        n_pieces = len(self.pieces)
        place, last, counts = [np.zeros(len(words), np.int64)], [np.array([-1])], [np.array([0])]
        totals = np.zeros(len(words), np.int64)
        for i in range(1, letters.shape[1] + 1):
            new = (shared < i) & (size >= i)
            place.append(np.cumsum(new) - 1)
            rows = np.flatnonzero(new)
            tokens, from_rows, from_ends = [], [], []
            for n in range(1, min(i, self.width) + 1):
                number = self._numbers(hashes[rows, i] - hashes[rows, i - n] * _POWERS[n])
                if n == 1:
                    number = np.where(number < 0, n_pieces + letters[rows, i - 1].astype(np.int64), number)
                hit = np.flatnonzero(number >= 0)
                tokens.append(number[hit])
                from_rows.append(hit)
                from_ends.append(np.full(len(hit), i - n))
            tokens, at, ends = np.concatenate(tokens), np.concatenate(from_rows), np.concatenate(from_ends)
            before, upto = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for j in range(max(0, i - self.width), i):
                some = ends == j
                where = place[j][rows[at[some]]]
                before[some], upto[some] = last[j][where], counts[j][where]
            ok = self._apart_all(before, tokens)
            if ok.sum() != len(rows) or len(np.unique(at[ok])) != len(rows):
                raise ValueError(f"no single token ends at {i} of {[words[r] for r in rows[:5]]}")
            level, sums = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
            level[at[ok]] = tokens[ok]
            spelt = np.where(tokens >= n_pieces, _utf8_bytes(tokens - n_pieces), 1)
            sums[at[ok]] = (upto + spelt)[ok]
            last.append(level)
            counts.append(sums)
            done = size == i
            totals[done] = sums[place[i][done]]
        self.words.update(zip(words, totals.tolist()))

    def totals(self, texts):
        """Tokens of each text. Words of all texts are learned together (very long ones
        are counted when met)."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        self.learn({w for w in set().union(*split) if 0 < len(w) <= CACHED_WORD_CHARS})
        word, out = self.words.__getitem__, []
        for t, ws in zip(texts, split):
            try:
                out.append(sum(map(word, ws)) if self._plain(t) else self.total(t or ""))
            except KeyError:  # a word too long to keep
                out.append(self.total(t))
        return out

    def word(self, w):
        n = self.words.get(w)
        return self.prefixes(w)[0][-1] if n is None else n

    def run(self, k):
        """Tokens of k space marks that stand alone."""
        ends, counts = self.run_ends, self.run_counts
        for i in range(len(ends), k + 1):  # the same program over prefixes, tokens told by their length
            for n in self.marks:
                if n <= i and (self._follows(SPACE * ends[i - n], SPACE * n) if n < i else self._starts(SPACE * n)):
                    ends.append(n)
                    counts.append(counts[i - n] + 1)
                    break
            else:
                raise ValueError(f"no token ends after {i} space marks")
        return counts[k]

    def after_run(self, k, counts, bare):
        """Tokens of k further space marks and then a prefix of a word."""
        return [self.run(k) + c if not b else self.run(k + 1) + c - 1 for c, b in zip(counts, bare)]

    def _pieces(self, text):
        """(further space marks, word, characters) in order; a text's first mark is added."""
        marks = 0
        for i, w in enumerate(text.replace(SPACE, " ").split(" ")):
            if w:
                yield marks, w
                marks = 0
            else:
                marks += 1
        if marks:
            yield marks, ""

    def _plain(self, text):
        """Whether words stand between single spaces."""
        return bool(text) and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " "

    def total(self, text):
        if not text:
            return 0
        if self._plain(text):
            return sum(map(self.word, text.split(" ")))
        return sum(self._end(marks, w) for marks, w in self._pieces(text))

    def _end(self, marks, w):
        """Tokens of one of `_pieces`."""
        if not w:
            return self.run(marks)
        if not marks:
            return self.word(w)
        counts, bare = self.prefixes(w)
        return self.after_run(marks, counts[-1:], bare[-1:])[0]

    def _inside(self, marks, w):
        """Tokens of every prefix of one of `_pieces`, from its first mark on."""
        out = [self.run(k) for k in range(1, marks + 1)]
        if w:
            counts, bare = self.prefixes(w)
            out += self.after_run(marks, counts[1:], bare[1:]) if marks else counts[1:]
        return out

    def every_prefix(self, text):
        """Tokens of text[:0], text[:1], ... text[:len(text)]."""
        out, base = [0], 0
        if not text:
            return out
        for marks, w in self._pieces(text):
            out += [base + x for x in self._inside(marks, w)]
            base = out[-1]
        return [0] + out[2:]  # the added space mark is no character of the text

    def cut(self, text, limit):
        """Characters of the longest prefix that has at most `limit` tokens. Counts at the
        ends of words only grow, so it ends inside the first word that goes beyond."""
        base, at = 0, -1  # the added space mark is no character of the text
        if self._plain(text):
            words = text.split(" ")
            k = bisect_right(list(accumulate(map(self.word, words))), limit)
            if k == len(words):
                return len(text)
            base, at = sum(map(self.word, words[:k])), sum(map(len, words[:k])) + k - 1
            rest = iter([(0, words[k])])
        else:
            rest = self._pieces(text) if text else iter(())
        for marks, w in rest:
            n = self._end(marks, w)
            if base + n > limit:
                return max([0, max(at, 0), *(at + j for j, c in enumerate(self._inside(marks, w), 1) if base + c <= limit)])
            base, at = base + n, at + marks + (1 + len(w) if w else 0)
        return len(text)


@common.kept
def counter(path):
    return PrefixCounter(path)


def _texts(batch):
    return [t or "" for t in batch.column("_text").to_pylist()]


def token_counts(df: DataFrame, limit: int, id_col="doc_id", text_col="text", model=MODEL) -> DataFrame:
    """One row per row of `df`: id, n_bytes, n_tokens, over_limit, and cut_chars, the
    characters that may stay under a budget of `limit` tokens."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        common.claim(counter)
        c = counter(common.tokenizer_path(model))
        for b in common.slices(batches, 4096):
            texts = _texts(b)
            n = []
            for lo, hi in common.steps(texts, STEP):
                n += c.totals(texts[lo:hi])
            cut = [len(t) if k <= limit else c.cut(t, limit) for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_bytes"), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(cut, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), size.alias("_bytes")).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_table(df: DataFrame, id_col="doc_id", text_col="text", model=MODEL) -> DataFrame:
    """One row per row of `df`: id and prefix_tokens, where element n (from 0) is the
    token count of the first n characters."""
    common.ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        common.claim(counter)
        c = counter(common.tokenizer_path(model))
        for b in batches:
            ids, texts = b.column("_id"), _texts(b)
            for lo, hi in common.steps(texts, 1 << 20):
                counts = pa.array([c.every_prefix(t) for t in texts[lo:hi]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), counts], names=[id_col, "prefix_tokens"])

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, prefix_tokens array<int>")


def tokens_at(prefix_tokens: Column, n_chars: Column) -> Column:
    """Tokens of the first n characters (of the whole text beyond its end)."""
    return F.element_at(prefix_tokens, (F.least(n_chars, F.size(prefix_tokens) - 1) + 1).cast("int"))


def chars_within(prefix_tokens: Column, budget: Column) -> Column:
    """The most characters whose count stays within a budget."""
    return F.array_max(F.transform(prefix_tokens, lambda c, i: F.when(c <= budget, i).otherwise(0)))
