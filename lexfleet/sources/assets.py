"""Brand assets inside dependency directories."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import fixed, ids, text as tx
from lexfleet.operators.ownership import containing_scope
from lexfleet.sources.files import inside_dependency_dir


def asset_signals(files: DataFrame) -> DataFrame:
    """`files`: (project_id, rel, text), text NULL unless it is a licence, notice or
    trademark file. -> (project_id, rel, signal, confidence, line, excerpt)."""
    f = files.filter(inside_dependency_dir()).withColumn("_base", F.lower(tx.base_name("rel"))).withColumn("_stem", tx.brand_stem("_base"))
    stem = f.filter(F.col("_stem").isin(fixed.BRAND_FILE_STEMS)).select(
        "project_id", "rel", F.lit("brand_filename").alias("signal"), F.lit("medium").alias("confidence"), F.lit(0).alias("line"), F.lit("").alias("excerpt"))
    folders = f.select("project_id", F.explode(tx.path_prefixes(tx.dir_name("rel"))).alias("rel")).filter(
        (F.lower(tx.base_name("rel")) == "brand") & inside_dependency_dir()).distinct().select(
        "project_id", "rel", F.lit("brand_directory").alias("signal"), F.lit("medium").alias("confidence"), F.lit(0).alias("line"), F.lit("").alias("excerpt"))
    trademark = F.col("_stem").isin(fixed.TRADEMARK_FILE_STEMS)
    notice = F.col("_base").isin(fixed.NOTICE_NAMES)
    legal = trademark | notice | tx.is_licence_file_name("_base")
    worded = f.filter(legal & F.col("text").isNotNull()).withColumn("norm", tx.normalise_text("text"))
    worded = worded.filter(trademark | tx.has_brand_reservation("norm")).withColumn("_e", tx.brand_evidence("text")).select(
        "project_id", "rel", F.when(trademark, "trademark_file").when(notice, "notice_clause").otherwise("licence_clause").alias("signal"),
        F.lit("high").alias("confidence"), F.col("_e.line").alias("line"), F.substring("_e.excerpt", 1, fixed.EXCERPT_CHARS).alias("excerpt"))
    return stem.unionByName(folders).unionByName(worded)


def asset_dependencies(signals: DataFrame, units: DataFrame) -> DataFrame:
    """The strongest signal of each directory as an asset row."""
    placed = signals.withColumn("dir", tx.dir_name("rel")).filter(F.col("dir") != ".")
    order = F.struct((F.col("confidence") != "high").alias("weak"), "rel", "signal")
    best = placed.groupBy("project_id", "dir").agg(
        F.min_by(F.struct("rel", "signal", "confidence", "line", "excerpt"), order).alias("s")).select("project_id", "dir", "s.*")
    scoped = containing_scope(best, units)
    return scoped.select(
        "project_id", ids.local_id("asset", "dir").alias("id"), F.lit("asset").alias("kind"), F.col("dir").alias("name"), F.lit("").alias("version"),
        F.lit("local").alias("ecosystem"), "scope", F.lit(True).alias("direct"), F.lit("").alias("spdx"), F.lit("").alias("raw"),
        F.lit("detection").alias("licence_source"), F.lit(False).alias("expression"), F.lit(False).alias("resolved"),
        F.col("confidence").alias("licence_confidence"), F.lit(None).cast("string").alias("declared_licence"),
        F.col("rel").alias("evidence_path"), F.col("line").alias("evidence_line"), "signal")
