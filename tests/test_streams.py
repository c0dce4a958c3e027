"""Keyed state: dependencies that come in again."""

import random

import pytest
from pyspark.sql import functions as F

from lexfleet.functions import ids
from lexfleet.operators import evaluate as ev
from lexfleet.operators.graph import upsert
from lexfleet.operators.resolve import with_licence_ref
from lexfleet.plans import bindings as b, core
from lexfleet.streaming import latest

LICENCES = ["MIT", "AGPL-3.0", "GPLv3", "", "SSPL-1.0", "CC BY-NC 4.0"]
VERSION = "project_id string, name string, at int, kind string, raw_text string"


def rows_of(df):
    deps = with_licence_ref(df.withColumnRenamed("raw_text", "licence_raw"))
    return deps.select(
        "project_id", ids.package_id(F.lit("npm"), F.col("name"), F.lit("1")).alias("id"), "kind", "name", F.lit("1").alias("version"), F.lit("npm").alias("ecosystem"), F.lit(".").alias("scope"),
        F.lit(True).alias("direct"), "spdx", "raw", "licence_source", "expression", "resolved", "licence_confidence", F.lit(None).cast("string").alias("declared_licence"),
        F.lit("f").alias("evidence_path"), F.lit(1).alias("evidence_line"), "at")


@pytest.mark.parametrize("seed", [1, 2])
def test_last_version_over_batches(spark, tmp_path, seed):
    """Late, repeated and changed versions, one of them without any outcome: after all
    batches the sums are those of the last versions."""
    rng = random.Random(seed)
    batches = [[(f"p{rng.randrange(3)}", f"n{rng.randrange(6)}", rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["package", "asset"]), rng.choice(LICENCES)) for _ in range(12)] for _ in range(4)]
    batches[3] += [batches[0][0], ("p9", "n1", 1, "package", "MIT")]
    everything = {}
    for x in [x for rows in batches for x in rows]:  # versions at one place must not differ here
        everything.setdefault(x[:3], x)
    batches = [[everything[x[:3]] for x in rows] for rows in batches]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(source)
    projects = spark.createDataFrame([(f"p{i}",) for i in range(10)], "project_id string")
    facts = {"x": {"use_commercial": True, "use_distributed": True}, "y": {"use_network_exposed": True, "use_modified": True, "use_distributed": False}}
    intents = b.literal_intents(projects, facts)
    stream = spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 1).parquet(source)
    changes = latest.last_outcomes(ev.evaluation_rows(rows_of(stream), intents, core.corpus()), core.corpus(), ["at"])
    epochs = []

    def write(batch, epoch):
        epochs.append(epoch)
        batch.write.parquet(str(tmp_path / f"out/epoch={epoch}"))

    with latest.state_store(spark):
        changes.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert len(epochs) == 4
    keys = ["project_id", "intent_id", "dependency_id", "dep_kind", "rule_id", "reason"]
    got = latest.standing(spark.read.schema(changes.schema).parquet(str(tmp_path / "out")), *keys)
    last = upsert(rows_of(spark.createDataFrame([x for rows in batches for x in rows], VERSION)).withColumn("stage_seq", F.coalesce("at", F.lit(0))))
    want = ev.evaluate(ev.evaluation_rows(last, intents, core.corpus()), core.corpus(), b.TODAY).groupBy(*keys).count()
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "n=") for r in want.collect())
    assert want.count() > 10


def test_state_store_is_put_back(spark):
    before = spark.conf.get(latest.PROVIDER, None)
    with latest.state_store(spark):
        assert spark.conf.get(latest.PROVIDER) == latest.ROCKSDB
    assert spark.conf.get(latest.PROVIDER, None) == before


def test_changes_of_every_epoch_add_up_without_python(spark, tmp_path):
    """Sums over the changes of the epochs so far are what stands after them, and state
    is kept by Spark's aggregate."""
    rng = random.Random(3)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(f"p{rng.randrange(2)}", f"n{rng.randrange(5)}", 10 * b + k, "package", rng.choice(LICENCES)) for k in range(6)] for b in (1, 0, 2)]
    for rows in batches:
        spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(source)
    intents = b.literal_intents(spark.createDataFrame([("p0",), ("p1",)], "project_id string"), {"x": {"use_commercial": True}})
    stream = spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 1).parquet(source)
    versions = latest.last_outcomes(ev.evaluation_rows(rows_of(stream), intents, core.corpus()), core.corpus(), ["at"])
    assert "TransformWithState" not in versions._jdf.queryExecution().analyzed().toString()
    with latest.state_store(spark):
        versions.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(
            lambda batch, epoch: batch.write.parquet(f"{out}/epoch={epoch}")).start().awaitTermination()
    landed = spark.read.parquet(out)
    keys = ["project_id", "dependency_id", "rule_id", "reason"]
    moved = latest.changes(landed)
    assert moved.filter("n < 0").count() > 0
    for e in range(3):
        got = moved.filter(F.col("epoch") <= e).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")
        want = latest.standing(landed.filter(F.col("epoch") <= e), *keys)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
