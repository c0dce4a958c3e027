"""The same fold on streams of findings. The maximum of outcome ranks is kept per
window and project, so state is one small row per key."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import severity as sev
from lexfleet.operators import verdict as vd


def windowed_verdicts(findings: DataFrame, window="1 day", lateness="1 hour") -> DataFrame:
    """Findings (ts, project_id, severity, confidence, reason) -> verdict per window. For
    update mode: a window's state ends when the watermark passes it."""
    banded = findings.withColumn("rule_id", F.lit("stream"))
    banded = vd.with_effective_severity(banded)
    grouped = banded.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "project_id").agg(
        F.max(vd.outcome_rank()).alias("rank"), F.count(F.lit(1)).alias("findings"))
    return grouped.select(F.col("w.start").alias("window_start"), "project_id", sev.verdict_from_rank(F.col("rank")).alias("verdict"), "findings")


def deduplicate(findings: DataFrame, lateness="1 hour") -> DataFrame:
    """A finding reported again within the watermark is dropped."""
    return findings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["project_id", "finding_id"])

