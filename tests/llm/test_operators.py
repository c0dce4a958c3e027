"""Each operator against a plain version, a round trip or held-out accuracy, and its edge cases."""

import hashlib
import json
import random
import re
import time
import zlib
from types import SimpleNamespace

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexfleet.llm import (
    byte_bpe, chat_links, common, contextual_pii, decontamination, embedding_near, graph, hard_negatives, language_id, licence_scan, ngram_join, packing, periodic_runs,
    queries, suffix_dedup, token_counts,
)

SF = "/root/testdata/sf0.001"
# columns that carry names the operators use themselves
CLASH = ("_id", "_text", "digest", "n", "part", "key", "kept", "lang_pred", "score", "start", "spans", "component_id", "n_links", "labels")


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def clash(df, **more):
    return df.withColumns({c: F.lit("x") for c in CLASH} | {c: F.lit(v) for c, v in more.items()})


def frame(spark, texts, lang=None):
    rows = [(i, t, lang[i] if lang else None) for i, t in enumerate(texts)]
    return clash(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(3)


EDGES = [None, "", " ", "\n\n", "1", "é", "a" * 30_000, "word " * 8_000, "same text here for all of us", "same text here for all of us"]


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(df.columns[0], *(columns or df.columns[1:])).collect()}


# 1 suffix-array dedup


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        s = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 50))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_with_large_numbers():
    s = np.array([5 << 20, 1, 5 << 20, 1, 5 << 20, 7, 1 << 21] * 9, np.int64)
    assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def repeats(seed=3):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([100, 199, 200, 201, 230, 900]))) for _ in range(9)]
    texts = []
    for _ in range(70):
        t = ""
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.5:
                p = rng.choice(parts)
                t += p[rng.choice([0, 0, rng.randrange(len(p))]) :]
            elif kind < 0.7:
                t += rng.choice(["ab", "x", "abcdefg"]) * rng.randint(10, 150)
            else:
                t += "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 400)))
        texts.append(t)
    return [*texts, texts[5], None, "", "z" * 199, "z" * 199, "q" * 200, "w" * 201]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, hot):
    texts = repeats()
    got = by_id(suffix_dedup.remove(frame(spark, texts), hot=hot), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute.windows_removed(texts)))


def test_suffix_dedup_edges(spark):
    df = frame(spark, EDGES)
    got = by_id(suffix_dedup.remove(df, keep_text=True), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute.windows_removed(EDGES)))
    assert suffix_dedup.remove(df.limit(0)).count() == 0
    same = df.filter("doc_id in (8, 9)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.repeat("text", F.lit(9)))
    assert [r.n_removed for r in suffix_dedup.remove(same).collect()] == [28 * 9] * 2


def test_suffix_sorts_stay_small(spark, monkeypatch):
    """One passage in many texts: no sort takes more than its limit, however often it stands there."""
    rnd, limit, plain = random.Random(5), 1 << 14, suffix_dedup.repeated
    word = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = word(300)
    texts = [word(rnd.randrange(150, 260)) + passage + word(rnd.randrange(150, 260)) for _ in range(300)] + [word(400) for _ in range(20)]

    def small(pieces, window):
        assert sum(map(len, pieces)) <= limit, "a sort beyond its limit"
        return plain(pieces, window)

    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "repeated", small)
    got = by_id(suffix_dedup.remove(frame(spark, texts), hot=16), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute.windows_removed(texts)))


# 2 language ID


def test_language_held_out(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_against_counts(spark, docs):
    """Naive Bayes from dictionaries, one n-gram at a time."""
    rows = docs.orderBy("doc_id").limit(60).collect() + [SimpleNamespace(doc_id=10_000 + i, text=t, lang=k) for i, (t, k) in enumerate([(None, "en"), ("", "de"), ("12 ...", "fr"), ("İstanbul ß ñ 中文", None), ("a", "en")])]
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string").repartition(4)
    got = by_id(language_id.identify(df), "lang_pred", "score")
    train = [zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows]
    factors = [int(f) for f in language_id.FACTORS]
    want = brute.naive_bayes([r.text for r in rows], [r.lang for r in rows], train, factors, language_id.BUCKET_BITS, language_id.SMOOTHING)
    for r, (lang, score) in zip(rows, want):
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 0.01, r.doc_id


def test_language_edges(spark):
    lang = ["en", "en", None, "fr", "en", "fr", "en", "fr", "en", "en"]
    df = frame(spark, EDGES, lang)
    got = by_id(language_id.identify(df), "lang_pred", "score")
    assert [got[i] for i in range(5)] == [("und", 0.0)] * 5
    assert {got[i][0] for i in range(5, 10)} <= {"en", "fr"} and got[8] == got[9]
    assert {r.lang_pred for r in language_id.identify(frame(spark, EDGES)).collect()} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0
    assert not by_id(language_id.identify(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))[None][0]


# 3 token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(common.tokenizer_path(token_counts.MODEL))


def test_prefix_counts(counter):
    rng = random.Random(1)
    letters = ["a", "b", " ", " ", "the", "in", "▁", "é", "\n", "\t", ".", "ﬁ", "中", "<0x41>", "</s>", "0", "ing", "😀"]
    for _ in range(800):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        want = [len(counter.model.encode(t[:i])) for i in range(len(t) + 1)]
        assert counter.every_prefix(t) == want
        assert counter.total(t) == want[-1] == counter.totals([t])[0]
        limit = rng.randint(0, 12)
        assert counter.cut(t, limit) == max(i for i, c in enumerate(want) if c <= limit)


def test_token_counts(spark, docs, counter):
    got = {r.doc_id: r for r in token_counts.token_counts(docs, 500).collect()}
    for r in docs.collect():
        n = len(counter.model.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit, got[r.doc_id].n_bytes) == (n, n > 500, len((r.text or "").encode()))
        assert len(counter.model.encode((r.text or "")[: got[r.doc_id].cut_chars])) <= 500


def test_token_edges(spark, counter):
    df = frame(spark, EDGES)
    got = by_id(token_counts.token_counts(df, 4096), "n_tokens")
    assert got == {i: (len(counter.model.encode(t or "")),) for i, t in enumerate(EDGES)}
    assert token_counts.token_counts(df.limit(0), 1).count() == 0
    table = token_counts.prefix_table(df.filter("doc_id > 7"))
    text = EDGES[8]
    row = table.select(token_counts.tokens_at(F.col("prefix_tokens"), F.lit(9)), token_counts.tokens_at(F.col("prefix_tokens"), F.lit(999)), token_counts.chars_within(F.col("prefix_tokens"), F.lit(3))).first()
    want = [len(counter.model.encode(text[:i])) for i in range(len(text) + 1)]
    assert tuple(row) == (want[9], want[-1], max(i for i, c in enumerate(want) if c <= 3))


# 4 n-gram Jaccard join


def families(seed):
    rng, rows = random.Random(seed), []
    for _ in range(30):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 3, 5, 6, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                i, kind = rng.randrange(len(w) + 1), rng.random()
                if kind < 0.7:
                    w[i : i + (kind < 0.4)] = [f"y{rng.randint(0, 99)}"]
                elif len(w) > 1:
                    del w[i : i + 1]
            rows.append(rng.choice([" ", "\n"]).join(w))
    return [*rows, *EDGES]


@pytest.mark.parametrize("few", [1, 2])
def test_ngram_join_of_wide_shingles(spark, monkeypatch, few):
    """Shingles of more sets than give pairs at once."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    texts = families(few)
    assert by_id(ngram_join.join(frame(spark, texts))) == brute.jaccard_classes(list(enumerate(texts)))


@pytest.mark.parametrize("blocks", [256, 2])
def test_ngram_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", blocks)
    texts = families(blocks)
    assert by_id(ngram_join.join(frame(spark, texts))) == brute.jaccard_classes(list(enumerate(texts)))


def test_ngram_join_edges(spark, docs):
    assert ngram_join.join(docs.limit(0)).count() == 0
    df = frame(spark, EDGES[-2:]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.component_id for r in ngram_join.join(df).collect()] == [None, None]
    rows = ngram_join.join(frame(spark, EDGES[-2:]).withColumn("doc_id", F.lit(4).cast("long"))).collect()
    assert [tuple(r) for r in rows] == [(4, 3, 4)] * 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = by_id(graph.components(spark.createDataFrame(edges, "u long, v long")))
    want = brute.classes({x for e in edges for x in e}, edges)
    assert got == {i: (c,) for i, c in want.items() if i in got} and {i for e in edges if e[0] != e[1] for i in e} == set(got)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 400)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(40)]
    bits = ngram_join.bitmaps(sets, 512)
    for i in range(40):
        for j in range(40):
            most = len(sets[i]) - int(np.bitwise_count(bits[i] & ~bits[j]).sum())
            assert len(np.intersect1d(sets[i], sets[j])) <= most


# 5 embeddings


@pytest.mark.parametrize("few", [embedding_near.FEW, 3, 0])
def test_near_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(embedding_near, "FEW", few)
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] * 64, [1.0, None] + [1.0] * 62, [1.0], [1.0] * 64, [2.0] * 64, [2.0] * 63 + [2.1], [3.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [3.0, 2.0, -3.0]]
    table = common.table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    df = clash(table.union(spark.createDataFrame([(-1 - i, v) for i, v in enumerate(bad)], table.schema)).union(table.limit(1)))
    rows = [(r.vec_id, embedding_near.clean(r.embedding)) for r in df.select("vec_id", "embedding").collect()]
    linked, links = [], {}
    for size in {len(v) for _, v in rows if v is not None}:  # every length for itself
        ids, x = [i for i, v in rows if v is not None and len(v) == size], np.array([v for _, v in rows if v is not None and len(v) == size])
        near = x @ x.T >= 0.95
        linked += [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))]
        links |= {ids[i]: int(near[i].sum()) - 1 for i in range(len(ids))}
    assert links[-7] == 1 and links[-12] == 1  # equal vectors of rarer lengths
    least = brute.classes([i for i, _ in rows], linked)
    want = {i: (links.get(i, 0), least[i], least[i] == i) for i, _ in rows}
    assert by_id(embedding_near.near_duplicates(df)) == want


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert by_id(embedding_near.near_duplicates(df)) == {1: (0, 1, True), None: (0, None, False)}
    assert embedding_near.near_duplicates(df.limit(0)).count() == 0


def test_visits_reach_the_target():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 32))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = embedding_near.Index(x, 12, 0.95)
    own, visited = index.visited(x)
    pairs = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95)) if i != j]
    assert len(pairs) > 300 and sum(own[j] in visited[i] for i, j in pairs) / len(pairs) >= 0.99


def test_groups_of_two_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_near, "PER_CELL", 1)  # as fine a grid as a large table has
    monkeypatch.setattr(embedding_near.fit, "__defaults__", (0.95, 48, *embedding_near.fit.__defaults__[2:]))
    monkeypatch.setattr(embedding_near.near_duplicates, "__defaults__", (*embedding_near.near_duplicates.__defaults__[:3], *[48] * (len(embedding_near.near_duplicates.__defaults__) - 3)))
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.29])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = by_id(embedding_near.near_duplicates(df), "n_links")
    assert want.sum() > 1000 and sum(got[i][0] for i in range(len(x))) >= 0.999 * want.sum()


# 6 decontamination


def test_myers():
    rng = random.Random(3)
    for _ in range(600):
        p, t = ([rng.choice("abc") for _ in range(n)] for n in (rng.randint(1, 12), rng.randint(0, 20)))
        best, k = brute.sellers(p, t), rng.randint(0, 4)
        got = decontamination.myers(p, t, k)
        assert (got is None) == (best > k or not t) and (got is None or got[0] == best)


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 4, 9, 20, 37])))) for i in range(25)] + [(100, None), (101, ""), (102, "...")]
    texts = []
    for _ in range(120):
        passage = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randint(0, 1)] = rng.choice([[], [word()]])
        texts.append(rng.choice([" ", ", "]).join([word() for _ in range(rng.randint(0, 30))] + [w.upper() for w in passage] + [word() for _ in range(9)]))
    texts += EDGES
    df, bench = frame(spark, texts), clash(spark.createDataFrame(items, "item_id long, text string"))
    want = set()
    for i, t in enumerate(texts):
        words = decontamination.normal(t).split()
        for item, text in items:
            p = decontamination.normal(text).split()
            if p and words and brute.sellers(p, words) <= len(p) // 5:
                want.add((i, item, brute.sellers(p, words)))
    for size in (decontamination.BLOCK_BYTES, 600):
        got = decontamination.leaks(df, bench, block_bytes=size).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want)
        left = decontamination.without_leaks(df, bench, block_bytes=size)
        assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, *_ in want} and left.columns == df.columns
    for r in got:
        assert brute.sellers(decontamination.normal(dict(items)[r.item_id]).split(), decontamination.normal(texts[r.doc_id]).split()[r.first_word : r.last_word + 1]) == r.distance
    assert decontamination.leaks(df.limit(0), bench).count() == decontamination.leaks(df, bench.limit(0)).count() == 0


# 7 personal data


def test_pii_base(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "x", "@", ".", "1", "255", "256", "+1 ", "(555) ", "-", " ", "4012429011158754", "00", "é", "\n", "_", "%", "com", "12.34.56.78", "+", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["1 " * 20_000, "a" * 30_000 + "@", "1.2.3." * 3_000, *EDGES]
    got = by_id(contextual_pii.find(frame(spark, texts)), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {i: brute.pii_row(t) for i, t in enumerate(texts)}


def test_pii_contexts(spark):
    seeds = [f"contact id: u{i}@mail.example.com now" for i in range(12)]
    texts = [*seeds, "contact id: member-77812 now", "in room 123456789 of 2020-01-01", "member-77812 alone", *("in room 99999%d" % i for i in range(8))]
    rows = {r.doc_id: r for r in contextual_pii.find(frame(spark, texts)).collect()}
    assert rows[12].spans == "context:12:24" and rows[14].spans == "context:0:12"
    assert all(rows[i].n_context == 0 and rows[i].n_email == 1 for i in range(12)) and all(rows[i].spans == "" for i in (13, *range(15, 23)))
    clean = {r.doc_id: r for r in contextual_pii.redact(frame(spark, [*texts, None, "", "a@b.co +1 212 555 0100 x"])).collect()}
    assert clean[12].text == "contact id: [CONTEXT] now" and clean[0].text == "contact id: [EMAIL] now" and clean[13].text == texts[13]
    assert clean[23].text is None and clean[24].text == "" and clean[25].text == "[EMAIL] [PHONE] x" and clean[0].digest == "x"


def test_pii_every_span_is_a_seed(spark):
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "3000 0000 0000 04", "6011 0000 0000 0004", "4012 8888 8888 1881", "5105 1051 0510 5100", "4222 2222 2222 2"]
    mails = [f"{c}ohn@example.com" for c in "abcdefgh"]
    phones = [f"+1 (743) 555-38{i:02}" for i in range(10, 18)]
    for word, known, unseen in (("dial", phones, "743x5553824"), ("charge", cards, "tok-99887766"), ("write", mails, "user77#example"), ("mail=", mails, "user78#example")):
        glue = "" if word.endswith("=") else " "
        texts = [f"please {word}{glue}{v} ok" for v in known] + [f"do {word}{glue}{unseen} now", "other ab12cd34 here"]
        rows = by_id(contextual_pii.find(frame(spark, texts)), "n_context", "spans")
        start = 3 if glue == "" else 3 + len(word) + 1
        end = 3 + len(word) + len(glue) + len(unseen)
        assert rows[8] == (1, f"context:{start}:{end}") and rows[9] == (0, "")
        assert all(rows[i][0] == 0 for i in range(8))


@pytest.mark.parametrize("support,threshold", [(3, 0.8), (1, 0.4)])
def test_pii_bootstrap(spark, support, threshold):
    """The spans that contexts add, against a graph in dictionaries."""
    rng = random.Random(3)
    names = ["call", "mail", "server", "card", "from", "the", "now"]
    values = ["a@b.co", "10.0.0.1", "x.y@site.org", "+12125550100", "4111111111111111", "zz12345", "code77881", "id=ab12cd34", "ID=99887766", "user:k4711x", "id=jim@b.co", "1234567", "12"]
    texts = [" ".join(rng.choice(names if rng.random() < 0.55 else values) for _ in range(rng.randint(1, 25))) for _ in range(60)] + [None, ""]
    got = by_id(contextual_pii.find(frame(spark, texts), support=support, threshold=threshold), "spans")
    want = brute.context_spans(texts, contextual_pii.ROUNDS, threshold, support, contextual_pii.LEAST_LENGTH)
    for i, spans in enumerate(want):
        found = [tuple(map(int, x.split(":")[1:])) for x in got[i][0].split(",") if x.startswith("context")]
        assert found == spans, texts[i]
    assert sum(map(len, want)) > 5


def test_pii_words_before_spans(spark):
    text = "a  b\n+1 (743) 555-3824 1.2.3.4,x=c@d.co tel:+1 743 555 3824"
    got = frame(spark, [text]).select(*(contextual_pii._places(F.col("text"), contextual_pii.PATTERNS[k], contextual_pii._valid_for(k)).alias(k) for k in contextual_pii.KINDS)).first()
    seen = {k: [(s.value, s.one, s.two, s.key) for s in got[k]] for k in ("email", "phone")}
    assert seen["email"] == [("c@d.co", "555-3824", "(743) 555-3824", "")]
    assert seen["phone"][-1] == ("+1 743 555 3824", "1.2.3.4,x=c@d.co", "555-3824 1.2.3.4,x=c@d.co", "tel:")


def test_pii_folds_in_parts(spark, monkeypatch):
    """Parts of any size give the same; overlaps of tokens and spans as tried one by one."""
    rng = random.Random(9)
    words = ["a@b.co", "x1234567", "4111 1111 1111 1111", "+1 (743) 555-3824", "id=ab12cd34", "10.0.0.1", "plain", "77", "a@b.co,99887766"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    df = frame(spark, texts)
    seen = []
    for part in (64, 3):
        monkeypatch.setattr(contextual_pii, "FOLD_PART", part)
        seen.append((by_id(contextual_pii.find(df, support=1, threshold=0.3)), by_id(contextual_pii.redact(df).select("doc_id", "text"))))
    assert seen[0] == seen[1]
    spans = lambda t: [(a, b) for _, a, b in brute.pii_spans(t)]
    token = contextual_pii._places(F.col("t"), contextual_pii.TOKEN, lambda m: F.length(m) >= 6)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", contextual_pii._untouched(token, F.concat(*(contextual_pii._places(F.col("t"), contextual_pii.PATTERNS[k], contextual_pii._valid_for(k)) for k in contextual_pii.KINDS))).alias("free"))
    for r in rows.collect():
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S*[0-9]\S*", texts[r.i]) if len(m.group()) >= 6]
        assert [(x.start, x.end) for x in r.free] == [(a, b) for a, b in tokens if not any(c < b and d > a for c, d in spans(texts[r.i]))]


def test_pii_of_very_long_texts(spark):
    """One megabyte of numbers, and one of spans and numbers: a square of this takes hours."""
    texts = ["1234567 " * 125_000, "a@b.co 1234567 " * 66_000]
    began = time.time()
    found = by_id(contextual_pii.find(frame(spark, texts)), "n_email", "n_card")
    assert found == {0: (0, 0), 1: (66_000, 0)}
    clean = by_id(contextual_pii.redact(frame(spark, texts)).select("doc_id", "text"))
    assert clean[1][0].startswith("[EMAIL] 1234567 [EMAIL]") and clean[1][0].count("[EMAIL]") == 66_000
    assert time.time() - began < 240


def test_pii_empty(spark, docs):
    assert contextual_pii.find(docs.limit(0)).count() == contextual_pii.redact(docs.limit(0)).count() == 0


# 8 licences (its SQL is compared with the other queries)


def test_licence_edges(spark):
    texts = [*EDGES, "CC BY cc by MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files", "x\nReleased under the MIT License.\ny"]
    got = by_id(licence_scan.scan(frame(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [got[i] for i in range(6)] == [(0, 0, None, None, "", "", 0.0)] * 4 + [(1, 0, None, None, "", "", 0.0)] * 2
    assert got[10] == (6, 3, 0, 4, "cc-by,mit", "cc-by,mit", 0.8) and got[12] == (7, 1, 4, 4, "mit", "mit", 1.0)
    assert got[11][4:6] == ("", "")  # the notice goes over two lines
    assert by_id(licence_scan.scan(frame(spark, texts), span=2), "labels")[11] == ("mit",)
    assert licence_scan.scan(frame(spark, EDGES).limit(0)).count() == 0


def test_licence_over_lines(spark, tmp_path):
    """The registered query against every window of every text, compared plainly."""
    rng = random.Random(8)
    notices = [words for _, words in licence_scan.TEMPLATES]
    texts = ["/*\n * Permission is hereby granted, free of charge,\n * to any person obtaining a copy of this software\n * and associated documentation files\n */", *EDGES]
    for n in range(120):
        words = rng.choice(notices).split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["the"], ["zzz"], ["software", "yyy"]])
        around = [rng.choice(["the", "license", "under", "software", "zzz"]) for _ in range(rng.randint(0, 30))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", ",\n# "]) for w in around + words + around[::-1]))
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op8_licence_scan(spark, str(tmp_path)), "labels", "score")
    lines = by_id(licence_scan.scan(frame(spark, texts)), "labels", "n_base")
    assert lines[0][0] == "" and got[0] == ("mit", 1.0)
    for i, t in enumerate(texts):
        split = lambda x: [w for w in re.split(licence_scan.NOT_WORD, x.lower()) if w]
        words, best = split(t or ""), {}
        for label, notice in licence_scan.TEMPLATES:
            want, size = set(notice.split()), -(-len(notice.split()) * 10 // 8)
            blocks = [split(x) for x in (t or "").split("\n")] + ([words[j : j + size] for j in range(len(words))] if want & set(words) else [])
            most = max(len(want & set(b)) / len(want) for b in blocks)
            if most >= 0.8:
                best[label] = max(most, best.get(label, 0))
        named = set(got[i][0].split(",")) - {""}
        assert set(best) <= named <= set(best) | {label for _, label in licence_scan.PHRASES}
        assert got[i][1] == max([0.8 if lines[i][1] else 0.0, *best.values()])


# 9 chat formatting


def test_chat_links(spark):
    def call(*calls):
        return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})

    rows = [
        (1, 0, "assistant", call(("a", "reply", {"prompt": "x", "turn": 1}, ["b"]))), (1, 1, "assistant", call(("b", "reply", {"turn": "z", "q": 1}, []))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "b": [1, 2.5, None]}})), (1, 3, "tool", '{"tool_call_id":"q","content":"o"}'),
        (1, 9, "assistant", call(("a", "reply", {}, []))), (2, 0, "assistant", call(("a", "nope", {}, ["b"]), ("b", "configure", [1], ["a"]))),
        (2, 1, "assistant", "{bad"), (2, 2, "user", None), (2, 3, None, ""), (None, 0, "assistant", call(("a", "configure", {"text": "t"}, ["gone"]))), (None, 1, "tool", '{"tool_call_id":"a","content":1}'),
    ]
    df = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), id=1, conv=2, body=3)
    got = {(r.conv_id, r.call_id, r.turn): (r.order_turn, r.order_hop, r.status, r.errors, r.json) for r in chat_links.link(df, queries.TOOLS).collect()}
    assert got == {
        (1, "b", 1): (1, 0, "unanswered", "prompt is missing; turn is no integer; q is unknown", '{"after":[],"arguments":{"q":1,"turn":"z"},"id":"b","name":"reply"}'),
        (1, "a", 0): (1, 1, "linked", "", '{"after":["b"],"arguments":{"prompt":"x","turn":1},"id":"a","name":"reply","result":{"b":[1,2.5,null],"z":1}}'),
        (1, "a", 9): (9, 0, "repeated", "prompt is missing; turn is missing", '{"after":[],"arguments":{},"id":"a","name":"reply"}'),
        (1, "q", 3): (3, 0, "orphan", "", '{"id":"q","result":"o"}'),
        (2, "a", 0): (0, 0, "cycle", "unknown tool", '{"after":["b"],"arguments":{},"id":"a","name":"nope"}'),
        (2, "b", 0): (0, 0, "cycle", "arguments are no object", '{"after":["a"],"arguments":[1],"id":"b","name":"configure"}'),
        (None, "a", 0): (0, 0, "linked", "after names gone", '{"after":["gone"],"arguments":{"text":"t"},"id":"a","name":"configure","result":1}'),
    }
    assert chat_links.link(df.limit(0), queries.TOOLS).count() == 0


def tool_graph(rng, conv, calls):
    """Messages of one conversation with random edges: chains, forks, rings, ids that are
    named before their turn or never called, repeated ids and equal rows."""
    rows = []
    for k in range(calls):
        after = [f"c{rng.choice([k - 1, k - 1, k - 1, rng.randrange(calls + 2)])}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        call = {"id": f"c{k}", "name": "configure", "arguments": {"text": f"{k}"}, "after": after}
        rows.append((conv, rng.randrange(4), "assistant", json.dumps({"tool_calls": [call]})))
        if rng.random() < 0.15:
            rows.append(rows[-1])
        if rng.random() < 0.15:
            rows.append((conv, rows[-1][1], "assistant", json.dumps({"tool_calls": [call | {"arguments": {"text": "other"}}]})))
    return rows


def in_order(rows):
    """(turn, hop) or None (cycle) of every call of one conversation, by the calls before it."""
    first = {}
    for _, turn, _, text in rows:
        (call,) = json.loads(text)["tool_calls"]
        first.setdefault(call["id"], []).append((turn, json.dumps(call["arguments"], separators=(",", ":")), call["after"]))
    first = {k: min(v) for k, v in first.items()}
    before = {k: [a for a in v[2] if a in first] for k, v in first.items()}
    out, left = {}, set(first)
    while True:
        ready = [k for k in left if not set(before[k]) & left]
        if not ready:
            return out | dict.fromkeys(left)
        for k in ready:
            out[k] = max([(first[k][0], 0), *((out[a][0], out[a][1] + 1) for a in before[k])] if all(out[a] for a in before[k]) else [(first[k][0], 0)])
        left -= set(ready)


def test_chat_order(spark):
    rng = random.Random(11)
    talks = {conv: tool_graph(rng, conv, rng.choice([1, 2, 3, 5, 9, 17, 33])) for conv in range(60)}
    ring = [(70, t, "assistant", json.dumps({"tool_calls": [{"id": a, "name": "configure", "arguments": {"text": "t"}, "after": [b]}]})) for t, a, b in ((0, "a", "b"), (1, "b", "a"), (2, "c", "b"))]
    chain = [(71, 0, "assistant", json.dumps({"tool_calls": [{"id": f"c{k}", "name": "configure", "arguments": {"text": "t"}, "after": [f"c{k + 1}"]} for k in range(100)]}))]
    frame = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    everything = [r for rows in talks.values() for r in rows] + ring + chain
    got = chat_links.link(frame(everything), queries.TOOLS).collect()
    assert len(got) == sum(map(len, talks.values())) + 3 + 100
    kept = {}
    for r in got:
        if r.status != "repeated":
            assert (r.conv_id, r.call_id) not in kept  # of equal rows one is no repetition
            kept[r.conv_id, r.call_id] = None if r.status == "cycle" else (r.order_turn, r.order_hop)
    want = {(conv, k): at for conv, rows in talks.items() for k, at in in_order(rows).items()}
    want |= {(70, "a"): None, (70, "b"): None, (70, "c"): None} | {(71, f"c{k}"): (0, 99 - k) for k in range(100)}
    assert kept == want and None in want.values()
    # what else is in the table changes nothing
    alone = {tuple(r) for r in chat_links.link(frame(talks[3] + ring), queries.TOOLS).collect()}
    assert alone == {tuple(r) for r in got if r.conv_id in (3, 70)}


# 10 packing


def check_pieces(rows, want):
    """want: id -> list of (ids as bytes), one for each row of that id."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    padded = sum(4096 - n for n in (sum(r.length for r in s) for s in sequences.values()) if n & (n - 1))
    for i, all_ids in want.items():
        pieces = sorted(documents[i], key=lambda r: (r.start, r.length))
        assert sorted({r.doc_tokens for r in pieces}) == sorted({len(b) // 4 for b in all_ids})
        if len(all_ids) == 1:
            at, ids = 0, all_ids[0]
            for r in pieces:
                assert r.start == at and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
                at += r.length
            assert at == len(ids) // 4
    return padded


def test_packing(spark, docs):
    enc = packing.encoder(common.tokenizer_path(packing.VOCABULARY))
    end = np.array([2], "<u4").tobytes()
    texts = [r.text for r in docs.collect()] + EDGES + ["<|endoftext|> a", "İ ß 中 Σ ́x", "half½ it's I'LL a.b"]
    got = packing.pack_documents(frame(spark, texts)).collect()
    library = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert check_pieces(got, {i: [np.array(ids, "<u4").tobytes() + end] for i, ids in enumerate(library)}) == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


def short_batches(seed=8):
    rng = random.Random(seed)
    for _ in range(12):
        yield [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 60))) for _ in range(6)]


def test_equal_sets_of_a_task_are_sent_once(spark):
    """Whatever the size of the Arrow batches, so that a pipeline can keep them small."""
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.range(60).coalesce(1).select(F.col("id").alias("_id"), F.lit(text).alias("_text"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        rows = ngram_join._fronts(df, np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8), 1, 5, ngram_join.THRESHOLD).collect()
    finally:
        spark.conf.set(key, before)
    (s,) = ngram_join.shingle_sets([text])
    assert sum(len(r["keys"]) for r in rows) == 8 * len(ngram_join.front(s, np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8)))


def test_full_word_caches(monkeypatch):
    """Words of a batch that were known before the cache filled up stay known for it."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    monkeypatch.setattr(token_counts, "CACHED_WORDS", 50)
    enc = packing.WordEncoder(common.tokenizer_path(packing.VOCABULARY))
    c = token_counts.PrefixCounter(common.tokenizer_path(token_counts.MODEL))
    enc.encode(["alpha beta gamma"])
    for texts in short_batches():
        texts = ["alpha", *texts]
        assert enc.encode(texts) == [packing.id_bytes(e.ids) for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert c.totals(texts) == [len(c.model.encode(t)) for t in texts]


def test_words_in_use_are_tokenized_once(monkeypatch):
    """A cache that fills up keeps the words that come again and again."""
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    enc, made = packing.WordEncoder(common.tokenizer_path(packing.VOCABULARY)), []
    part = enc._part
    monkeypatch.setattr(enc, "_part", lambda p: made.append(p) or part(p))
    for i in range(40):
        enc.encode(["alpha " + " ".join("abcdefghij"[k % 10] + "klmnopqrst"[i % 10] + "uvwxyzabcd"[i // 10] for k in range(10))])
    assert made.count("alpha") == 1 and len(made) >= 400


def test_long_runs_of_spaces():
    c = token_counts.PrefixCounter(common.tokenizer_path(token_counts.MODEL))
    assert [c.run(k) for k in range(2, 300)] == [len(c.model.encode(" " * (k - 1))) for k in range(2, 300)]
    text = "a" + " " * 200_000 + "b"  # a square of this would take an hour
    cut = c.cut(text, 200)
    assert len(c.model.encode(text[:cut])) <= 200 < len(c.model.encode(text[: cut + 1]))


def test_packer_limits():
    rng = random.Random(6)
    sizes = [rng.randint(1, 200) for _ in range(500)]
    for cut in (True, False):
        p = packing.DotProductPacker(300, 5, 150, cut=cut, pool=40)
        loss = [min(n, rng.randint(0, 150)) for n in sizes]
        out = list(p.add(zip(range(500), sizes, loss))) + list(p.finish())
        bins, done = {}, {}
        for key, start, length, seq, offset in out:
            bins.setdefault(seq, []).append((offset, length))
            done.setdefault(key, []).append((start, length))
        for b in bins.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 300 and len(b) <= 5
        assert all(sum(n for _, n in done[k]) == sizes[k] for k in range(500)) and (cut or all(len(v) == 1 for v in done.values()))
    with pytest.raises(ValueError):
        list(packing.DotProductPacker(10, 2, 10, cut=False).add([(1, 11, 0)]))


def test_pack_examples(spark):
    df = spark.createDataFrame([(i, n, n // 2) for i, n in enumerate([100, 900, 0, 1000, 30, 500])] + [(9, None, 3)], "id long, n long, loss long")
    rows = packing.pack_examples(df, 1000, 3, 600, "id", "n", "loss").collect()
    assert sorted(r.id for r in rows) == [0, 1, 3, 4, 5]


# 11 hard negatives


def vectors(seed, n, dim=4, labels=3, spread=6):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(labels), [rng.randint(-spread, spread) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rng.randrange(labels), rows[7][2]) for i in range(n // 3)]  # one vector, many times
    rows += [(2 * n + i, i % labels, [rng.randint(-3, 9) for _ in range(dim + 1)]) for i in range(20)] + [(3 * n, 0, []), (3 * n + 1, 1, []), (3 * n + 2, 0, [])]
    return rows


def mined(df, every=5):
    got = hard_negatives.mine(df, F.col("vec_id") % every == 0).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


@pytest.mark.parametrize("tile,leaf,anchors", [(4096, 128, 16_384), (64, 8, 16_384), (40, 5, 30)])
def test_hard_negatives(spark, monkeypatch, tile, leaf, anchors):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = vectors(tile, 150)
    none = [(9_000, None, [1.0] * 4), (9_005, 0, None), (9_010, 0, [1.0, None, 1.0, 1.0]), (9_015, 1, [1.0, float("nan"), 1.0, 1.0]), (9_020, 1, [float("inf")] * 4), (None, 1, [1.0] * 4)]
    df = spark.createDataFrame([(i, k, None if v is None else [x if x is None else float(x) for x in v]) for i, k, v in rows + none], "vec_id long, label int, embedding array<float>")
    more = df.unionByName(df.filter("vec_id in (5, 6)"))  # repeated rows count once
    assert mined(clash(more.repartition(5), rank=1, id=0, anchor=1, vector=2, slab=3)) == brute.hard_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_in_long_numbers(spark):
    """Scores beyond 2**53 are whole numbers too."""
    rows = [(i, k, [x * (1 << 26) + i for x in v]) for i, k, v in vectors(3, 30)]
    df = spark.createDataFrame([(i, k, [float(x) for x in v]) for i, k, v in rows], "vec_id long, label int, embedding array<double>")
    assert mined(df) == brute.hard_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_of_text_ids(spark):
    rows = [(f"v{i:04}", f"label {k}", v) for i, k, v in vectors(4, 60)]
    df = spark.createDataFrame([(i, k, [float(x) for x in v]) for i, k, v in rows], "vec_id string, label string, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id").endswith("5")).collect()
    assert set(map(tuple, got)) == brute.hard_negatives(rows, lambda i: i.endswith("5"))


def test_no_hard_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(5, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(one, F.col("vec_id") % 5 == 0).collect() == []


def test_op11(spark):
    rows = []
    for r in common.table(spark, SF, "embeddings").collect():
        rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]))
    assert set(map(tuple, queries.op11_hard_negatives(spark, SF).collect())) == brute.hard_negatives(rows, lambda i: i % 50 == 0)


def test_tree_bounds():
    rng = np.random.default_rng(1)
    tree = hard_negatives.Tree(np.arange(900), np.arange(900) % 3, rng.integers(-9, 9, (900, 6)).astype(float))
    anchors = rng.integers(-9, 9, (5, 6)).astype(float)
    high, low = tree.bounds(anchors)
    for i, a in enumerate(anchors):
        for leaf in range(tree.sizes[0]):
            s = tree.scores(leaf, a, True)
            assert low[i, leaf] <= s.min() and s.max() <= high[i, leaf]
    seen = []
    tree.search(anchors[0], high[0].tolist(), low[0].tolist(), True, lambda h, lo: True, lambda ids, labels, s: seen.extend(ids.tolist()))
    assert sorted(seen) == list(range(900))


# 12 periodic runs


def repetitive(rng, depth=0):
    kind = rng.random()
    if kind < 0.3:
        return [rng.choice("ab") for _ in range(rng.randint(1, 12))]
    if kind < 0.5:
        return [rng.choice("abcdefghijk") for _ in range(rng.randint(1, 30))]
    if kind < 0.9 and depth < 4:
        part = repetitive(rng, depth + 1)
        many = (part * rng.randint(2, 9))[:2000]
        return many[: len(many) - rng.randint(0, len(part) - 1)]
    return repetitive(rng, depth + 1) + repetitive(rng, depth + 1) if depth < 5 else ["z"]


@pytest.mark.parametrize("seed", range(3))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(70):
        texts = [" ".join(repetitive(rng) + repetitive(rng)) for _ in range(rng.randint(1, 6))] + [None, "", "a", " \t\n"]
        for t, (words, found) in zip(texts, periodic_runs.find_runs(texts)):
            assert words == (t or "").split() and found == brute.runs(words)
            assert periodic_runs.collapse(words, found) == brute.without_repeats(words, found)


def test_synchronising_positions():
    """Equal contexts are picked alike, and t positions in a row hold a picked one."""
    rng = random.Random(5)
    text = [rng.randrange(3) for _ in range(400)]
    words = np.array(text + text[50:300] + [9, 8] + text, np.int64)
    names, t = words.astype(np.uint64), 8
    for k in (1, 2, 4):
        names = periodic_runs._mixed(names[:-k], names[k:])
    picked = set(periodic_runs.synchronising(names, t).tolist())
    contexts = {}
    for i in range(len(words) - 2 * t + 1):
        contexts.setdefault(tuple(words[i : i + 2 * t].tolist()), set()).add(i in picked)
    assert all(len(x) == 1 for x in contexts.values())
    assert all(picked & set(range(i, i + t)) for i in range(len(words) - 3 * t + 2))


def test_runs_of_a_long_text():
    words = ["a", "b", "c"] * 200_000 + ["x"] + ["a"] * 300_000
    ((_, found),) = periodic_runs.find_runs([" ".join(words)])
    assert found == [(0, 600_000, 3), (600_001, 300_000, 1)]


def test_periodic_runs(spark):
    texts = EDGES + ["a b " * 9, "x" + "\u00a0y" * 20, "p q r " * 3, "A a " * 8, "v\x0bw\x0c" * 9, "é è " * 30]
    got = by_id(periodic_runs.find(clash(frame(spark, texts), runs=1, n_words=2, collapsed=3)), "n_words", "runs", "collapsed")
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute.runs(words) if len(words) < 9_000 else [(0, len(words), 1)]
        assert got[i][0] == len(words) and [tuple(r) for r in got[i][1]] == found and got[i][2] == " ".join(brute.without_repeats(words, found))
    assert periodic_runs.find(frame(spark, texts).limit(0)).count() == 0


def test_op12(spark, docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute.runs(words)
        top = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[r.doc_id] = (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(brute.without_repeats(words, found))))
    assert by_id(queries.op12_periodic_runs(spark, SF)) == want
    assert any(w[0] for w in want.values())


# 13 byte-level BPE


def library(bpe):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return byte_bpe.ByteBpe(common.tokenizer_path(byte_bpe.RANKS), public_tokenizers.PATTERN)


def test_segment_trees(bpe, monkeypatch):
    rng, lib = random.Random(2), library(bpe)
    letters = [32, 10, 9, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, *range(33, 127), *range(0xC0, 0x180), *range(0x4E00, 0x4E20), *range(0x1F600, 0x1F610), 0x301]
    for cap in (byte_bpe.CACHED_PIECES, 40):
        monkeypatch.setattr(byte_bpe, "CACHED_PIECES", cap)
        for _ in range(60):
            texts = ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(0, 60))) for _ in range(25)]
            texts += ["a" * rng.randint(0, 300), "ab" * rng.randint(0, 700), " " * rng.randint(0, 90) + "x", "".join(rng.choice("aeiounst") for _ in range(1500)), "<|endoftext|>"]
            got = bpe.encode(texts)
            assert got == [byte_bpe._little(lib.encode_ordinary(t)) for t in texts]
            assert [bpe.decode(x).decode() for x in got] == texts
    pieces = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 1024))).encode() for _ in range(100)]
    assert bpe.merge_table(pieces) == list(map(bpe.merge_one, pieces))


def test_very_long_texts_in_bytes(bpe, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART_CHARS", 50)
    rng, lib = random.Random(4), library(bpe)
    for _ in range(40):
        t = "".join(rng.choice(["word", " ", "  ", "\n", "12", "!", "é", "'s", "x" * 70, " " * 70]) for _ in range(rng.randint(0, 200)))
        assert bpe.encode([t, t[3:]]) == [byte_bpe._little(lib.encode_ordinary(x)) for x in (t, t[3:])]
    long = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert bpe.decode(bpe.encode([long])[0]).decode() == long


def test_byte_bpe(spark, docs, bpe):
    texts = [r.text for r in docs.collect()] + EDGES
    lib = library(bpe)
    df = clash(frame(spark, texts), ids=1, bytes=2)
    ids = byte_bpe.encode(df)
    got = by_id(byte_bpe.decode(ids, keep=("doc_id", "ids")), "ids", "bytes")
    for i, t in enumerate(texts):
        assert bytes(got[i][0]) == byte_bpe._little(lib.encode_ordinary(t or "")) and bytes(got[i][1]) == (t or "").encode()
    assert byte_bpe.encode(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [bytes(r.bytes) for r in byte_bpe.decode(nothing).collect()] == [b""]
    with pytest.raises(Exception, match="4000000000|KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, byte_bpe._little([4_000_000_000]))], "doc_id long, ids binary")).collect()
    row = queries.op13_byte_bpe(spark, SF).filter("doc_id = 3").first()
    e = lib.encode_ordinary(docs.filter("doc_id = 3").first().text or "")
    assert row.n_tokens == len(e) and row.ids_sha256 == hashlib.sha256(byte_bpe._little(e)).hexdigest()
