"""Dependencies that come in again: the last version of each counts, across micro-batches.

A dependency's outcomes are computed without state, as one text with all of them. The
state keeps one value per dependency: the position of its latest version and that
version's outcomes, as the greatest of them so far. An epoch gives the standing version of
every dependency that it touched; an earlier version that comes late changes nothing.

`standing` adds up the last of these, so its sums are those of a batch run over the last
versions, after every epoch. `changes` tells them as outcomes that are added (n = 1) and
taken back (n = -1) by each epoch, for sums that are kept elsewhere.

Keys are dependencies, not projects, so a hot project is spread over the shuffle. A
repeated epoch gives the same versions, because the state is that of its start. State is
read and written by Spark's own aggregate: no row of it goes through Python.

Needs the RocksDB state store, which `state_store` names for the time of a query.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexfleet.operators import evaluate as ev

OUTCOME = ev._STRUCT
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["project_id", "intent_id", "dependency_id"]


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed values need, for queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def last_outcomes(rows: DataFrame, corpus, position: list) -> DataFrame:
    """rows: a stream of evaluation rows (dependency version x intent) with the columns of
    `position`, which order the versions of one dependency (a missing part comes before
    all others; of versions at one place the greatest text counts). Gives a stream for
    update mode: project_id, intent_id, dependency_id, last (the position and outcomes)."""
    said = F.to_json(F.struct(F.col("kind"), ev.outcome_array(corpus).alias("hits")))
    known = rows.select("project_id", "intent_id", F.col("id").alias("dependency_id"), F.struct(*position, said.alias("outcomes")).alias("version"))
    return known.groupBy(*KEYS).agg(F.max("version").alias("last"))


def _outcomes(versions: DataFrame, *more) -> DataFrame:
    """One row per outcome of some versions."""
    read = versions.withColumn("o", F.from_json("last.outcomes", f"struct<kind:string,hits:array<{OUTCOME}>>"))
    return read.select(*KEYS, *more, F.col("o.kind").alias("dep_kind"), F.explode("o.hits").alias("hit")).select(
        *KEYS, "dep_kind", "hit.rule_id", "hit.source", "hit.reason", F.col("hit.field").alias("undetermined_field"), *more)


def standing(versions: DataFrame, *keys) -> DataFrame:
    """Outcomes that stand after some epochs of `last_outcomes`, with their number, by `keys`."""
    last = versions.groupBy(*KEYS).agg(F.max("last").alias("last"))
    return _outcomes(last).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def changes(versions: DataFrame, epoch="epoch") -> DataFrame:
    """Outcomes that every epoch added (n = 1) and took back (n = -1). versions: what
    `last_outcomes` gave, with the epoch. A version that an epoch only repeats is no change."""
    before = F.lag("last").over(W.partitionBy(*KEYS).orderBy(epoch))
    moved = versions.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("last.outcomes") != F.col("_before.outcomes")))
    both = F.array_compact(F.array(F.struct(F.col("last").alias("last"), F.lit(1).alias("n")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("last"), F.lit(-1).alias("n")))))
    return _outcomes(moved.select(*KEYS, epoch, F.inline(both)), epoch, "n")
