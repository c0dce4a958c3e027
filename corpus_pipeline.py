"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; all but the last return the columns of `documents`. run() writes
each result as Parquet into the shared folder and reads it again. Stages that drop
documents keep every document that their operator does not object to.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexfleet.llm import common, contextual_pii, decontamination, language_id, ngram_join, packing

CONTEXT = 4096
FEW_ROWS = 1000  # of an Arrow batch
LEAST_SCORE = 0.5  # a language that is less likely than all others together is rejected


def _rows_per_batch(spark: SparkSession, rows: int) -> None:
    """How many rows Spark hands to a Python step at a time, from here on: whole texts are
    large, and a batch stands in the JVM and in the worker. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a language that stands out."""
    _rows_per_batch(spark, FEW_ROWS)
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    found = language_id.predict(docs, model, lang="_language_found", score="_language_score")
    return found.filter((F.col("_language_found") != language_id.UNKNOWN) & (F.col("_language_score") >= LEAST_SCORE)).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; rows without an id are
    in no group and stay. Rows that repeat an id stay or go together, and of those that
    repeat the text as well one stays: no text is lost."""
    _rows_per_batch(spark, FEW_ROWS)
    groups = common.staged(ngram_join.join(docs))
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    few = first.count() <= ngram_join.BROADCAST_IDS
    kept = docs.join(F.broadcast(first) if few else first, "doc_id", "left_semi")
    if groups.count() > groups.select("doc_id").distinct().count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).union(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    _rows_per_batch(spark, FEW_ROWS)
    return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data; n_chars follows."""
    clean = contextual_pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    _rows_per_batch(spark, FEW_ROWS)
    return packing.pack_documents(docs, tokens=CONTEXT)


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL cannot express the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
