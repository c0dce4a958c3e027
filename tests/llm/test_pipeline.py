"""The pipeline against plain versions of its stages."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from lexfleet.llm import common, decontamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    strange = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5), (10**6 + 3, "mail a.b@c.org today", None, None, 20)], docs.schema)
    docs = docs.union(strange).withColumn("extra", F.lit("e"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_join", "decontamination", "pii", "packing"]

    known = stages["language_id"](spark, docs, SF)
    assert known.columns == docs.columns
    left = {r.doc_id: r.text for r in known.collect()}
    assert set(left) == {r.doc_id for r in docs.collect()} - {10**6, 10**6 + 1, 10**6 + 2}

    single = stages["ngram_join"](spark, known, SF)
    classes = brute.jaccard_classes(list(left.items()))
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in classes.items() if c == i)

    items = [decontamination.normal(r.text).split() for r in common.table(spark, SF, "benchmark").collect()]
    clean = stages["decontamination"](spark, single, SF)
    want = {r.doc_id for r in single.collect() if not any(brute.sellers(p, decontamination.normal(r.text).split()) <= len(p) // 5 for p in items)}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns

    masked = {r.doc_id: r for r in stages["pii"](spark, clean, SF).collect()}
    assert set(masked) == want
    for i, r in masked.items():
        assert not brute.pii_spans(r.text) and r.n_chars == len(r.text) and r.extra == "e"
        if not brute.pii_spans(left[i]):
            assert r.text == left[i] or "[CONTEXT]" in r.text


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text), (3, "other words that no one else has here")], "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0), (True, 0)]


def test_ids_with_several_texts(spark):
    """Rows that repeat an id are no copies of each other unless their texts are."""
    rows = [(1, "one two three four five six seven"), (1, "a quite other text with words of its own"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, "and a third one that stands for itself here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({rows[0], rows[1], rows[4]})


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, common.table(spark, SF, "documents").limit(0), SF)
        assert empty.count() == 0
