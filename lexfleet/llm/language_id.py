"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of other characters than letters becomes one
space, and its n-grams of one to three characters are hashed into a fixed number of
buckets. Training counts buckets per language over all labelled texts in Spark;
only the model (languages x buckets, a size that does not grow with the data) goes
to the driver and is broadcast. Scoring sums the log-probabilities of a batch of
texts in numpy, as a sparse product with one entry for every n-gram.

Defined cases: a text that is null or has no letter is `und` with score 0; without
any labelled text every text is `und`; ties go to the language that sorts first; a
null label is not learned from; repeated rows count and are scored as often as they
occur; other columns are not looked at; an empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.llm import common

UNKNOWN = "und"
BUCKET_BITS = 16
SMOOTHING = 0.1
MAX_LANGUAGES = 1000  # bounds the model: 1000 languages are 256 MB
STEP = 1 << 20  # characters that are hashed at once
FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@common.kept
def _letters():
    """For every code point: its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngrams(texts):
    """Bucket numbers of the n-grams of a list of texts: a list with one (buckets,
    text numbers) pair for each length, and which texts have a letter."""
    joined = "".join(f" {t or ''} " for t in texts)
    sizes = np.array([len(t or "") + 2 for t in texts])
    x = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (of[1:] != of[:-1])
    x, of = x[keep], of[keep]
    out, mixed = [], np.zeros(len(x), np.uint32)
    for n, factor in enumerate(FACTORS):
        m = len(x) - n
        if m <= 0:
            break
        mixed = (mixed[:m] ^ (x[n:] + np.uint32(n + 1))) * factor
        mixed ^= mixed >> np.uint32(15)
        same = of[n:] == of[:m]
        if n == 0:
            same &= x != 32
        out.append(((mixed[same] * FACTORS[0]) >> np.uint32(32 - BUCKET_BITS), of[:m][same]))
    return out, np.bincount(of[x != 32], minlength=len(texts)) > 0


def _counts(labels, texts, languages):
    """Add the bucket counts of labelled texts to a table by language."""
    for lo, hi in common.steps(texts, STEP):
        grams, _ = ngrams(texts[lo:hi])
        names, of = np.unique(np.array(labels[lo:hi], object).astype(str), return_inverse=True)
        for buckets, rows in grams:
            got = np.bincount(of[rows].astype(np.int64) << BUCKET_BITS | buckets, minlength=len(names) << BUCKET_BITS).reshape(len(names), -1)
            for k, name in enumerate(names):
                languages.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))[:] += got[k]


class Model:
    """languages in order, log-probabilities (language x bucket) and log-priors."""

    def __init__(self, languages, counts, texts):
        self.languages = languages
        if languages:
            counts = np.asarray(counts, float) + SMOOTHING
            self.table = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
            self.prior = np.log(np.asarray(texts, float) / sum(texts))

    def score(self, texts):
        """Predicted language and its posterior probability for each text."""
        grams, lettered = ngrams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.repeat(self.prior[:, None], len(texts), axis=1)
        for buckets, rows in grams:
            if len(rows):
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                for k, row in enumerate(self.table):
                    total[k, rows[starts]] += np.add.reduceat(row[buckets], starts, dtype=np.float64)
        best = total.argmax(axis=0)
        share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(share, lettered)]


def fit(df: DataFrame, text_col="text", lang_col="lang") -> Model:
    """Train on all rows with a label. Starts a job."""
    common.ship(df.sparkSession)

    def run(batches):
        common.claim(_letters)
        languages, seen = {}, {}
        for b in common.slices(batches):
            labels, texts = b.column("_lang").to_pylist(), b.column("_text").to_pylist()
            for lang in labels:
                seen[lang] = seen.get(lang, 0) + 1
            _counts(labels, texts, languages)
        for lang, n in seen.items():
            counts = languages.get(lang, np.zeros(1 << BUCKET_BITS, np.int64))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, counts[at]].astype(np.int64))], names=["lang", "bucket", "n"])

    labelled = df.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")).filter("_lang is not null")
    rows = labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # bucket -1 is the number of texts; one row per language and bucket at most
    got = rows.toArrow()
    names, of = np.unique(np.array(got.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model holds {MAX_LANGUAGES}")
    if not len(names):
        return Model([], [], [])
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros((len(names), 1 << BUCKET_BITS), np.int64)
    inside = bucket >= 0
    counts[of[inside], bucket[inside]] = n[inside]
    texts = np.zeros(len(names), np.int64)
    texts[of[~inside]] = n[~inside]
    return Model([str(x) for x in names], counts, texts)


def predict(df: DataFrame, model: Model, text_col="text", lang="lang_pred", score="score") -> DataFrame:
    """All columns of `df` and the predicted language with its probability; columns
    that have these two names already are replaced."""
    common.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in df.schema.fields if f.name not in (lang, score)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{lang}` string", f"`{score}` double"])

    def run(batches):
        common.claim(_letters)
        m = shared.value
        for b in common.slices(batches):
            texts = b.column(text_col).to_pylist()
            langs, scores = [], []
            for lo, hi in common.steps(texts, STEP):
                a, s = m.score(texts[lo:hi])
                langs += a
                scores += s
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in fields), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in fields), lang, score])

    return df.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, schema)


def held_out(id_col: Column, modulus=4, remainder=2) -> Column:
    """A row's fold by the checksum of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(df: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", keep=()) -> DataFrame:
    """Learn from the rows that are not held out and predict all: id, held_out,
    lang_pred, score, and the columns named in `keep`."""
    out = held_out(F.col(id_col))
    model = fit(df.filter(~out & F.col(id_col).isNotNull()), text_col, lang_col)
    rows = df.select(F.col(id_col), out.alias("held_out"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    got = predict(rows, model, "_text")
    return got.select(id_col, "held_out", "lang_pred", "score", *(F.col(f"_keep_{c}").alias(c) for c in keep))
