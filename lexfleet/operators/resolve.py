"""Licence resolution: dependencies against the licence dimension.

The dimension is the corpus (bounded), so every join here is a broadcast hash
join on one normalised key and moves no dependency rows.
"""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import spdx as spdx_fn
from lexfleet.session import small_side


def licence_dimension(spark, corpus, prefix="entry_") -> DataFrame:
    d = corpus.frame(spark, "licences")
    return d.select(
        F.col("spdx_key").alias(f"{prefix}key"),
        F.col("spdx_id").alias(f"{prefix}spdx"),
        F.col("family").alias(f"{prefix}family"),
        F.col("permissiveness").alias(f"{prefix}permissiveness"),
        F.col("entry_confidence").alias(f"{prefix}confidence"),
    )


def resolve(df: DataFrame, corpus, spdx_column="spdx", prefix="entry_") -> DataFrame:
    """Left join to the licence dimension; unmatched rows get NULL entry columns."""
    dim = licence_dimension(df.sparkSession, corpus, prefix)
    keyed = df.withColumn(f"{prefix}key", spdx_fn.lookup_key(F.col(spdx_column)))
    return keyed.join(small_side(dim), f"{prefix}key", "left")


def with_licence_ref(df: DataFrame, raw_column="licence_raw", source="manifest") -> DataFrame:
    """Raw licence text of a declaration -> spdx, raw, licence_source, expression,
    resolved, licence_confidence."""
    ref = df.withColumn("_ref", spdx_fn.licence_ref(raw_column, source))
    return ref.select(
        *[c for c in df.columns],
        F.col("_ref.spdx").alias("spdx"),
        F.col("_ref.raw").alias("raw"),
        F.col("_ref.source").alias("licence_source"),
        F.col("_ref.expression").alias("expression"),
        F.col("_ref.resolved").alias("resolved"),
        F.col("_ref.confidence").alias("licence_confidence"),
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Rows no rule can be decided for, with the reason."""
    named = F.col("resolved") & (F.col("spdx") != "")
    reason = F.when(~named, F.lit("licence_unresolved")).when(
        F.col("entry_spdx").isNull(), F.lit("no_corpus_entry"))
    routed = resolved.filter(~F.col("kind").isin("asset", "upstream_cli"))
    return routed.withColumn("reason", reason).filter(F.col("reason").isNotNull())
