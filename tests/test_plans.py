"""Plans keep the shape that scales: no nested loops, pruned scans, bounded broadcasts."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import bench
from lexfleet import session
from lexfleet.plans import load_queries, report_queries

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", bench.HEADLINE)
def test_no_nested_loops(spark, name):
    plan = physical(load_queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_big_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(load_queries()["verdict_counts"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_scans_read_only_what_is_used(spark):
    prose = load_queries()["licence_prose"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in prose
    wide = physical(load_queries()["upsert_last_wins"](spark, SF))
    assert "l_comment" not in wide and "l_tax" not in wide.split("ReadSchema")[-1]


def test_pre_aggregation_comes_before_the_shuffle(spark):
    plan = physical(load_queries()["verdict_fold"](spark, SF))
    assert "partial_max" in plan and "partial_sum" in plan


def test_streams_arrive_in_order(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events = events.withColumn("ts", (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(cast(event_id % 400 as int))")).cast(events.schema["ts"].dataType))
    events.write.parquet(f"{tmp_path}/events.parquet")
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    report_queries._arriving(spark, table, "ts")
    arrived = max(pathlib.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("arrivals-*"), key=lambda p: p.stat().st_mtime)
    ends = spark.read.parquet(str(arrived)).groupBy("_metadata.file_modification_time").agg(F.min("ts"), F.max("ts")).orderBy("file_modification_time").collect()
    assert len(ends) == report_queries.ARRIVALS and all(a[2] <= b[1] for a, b in zip(ends, ends[1:]))
    found = load_queries()["stream_verdict"](spark, str(tmp_path))
    assert found.agg(F.sum("findings")).first()[0] == table.count()
