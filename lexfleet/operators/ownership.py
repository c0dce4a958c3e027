"""Who owns a file: longest name or directory prefix, as equi-joins on prefixes."""

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.functions import fixed, ids, text
from lexfleet.session import fact_join, grown


def containing_scope(files: DataFrame, units: DataFrame) -> DataFrame:
    """Adds `scope`: the deepest unit directory above the file, `.` when none."""
    dirs = units.select("project_id", "dir").distinct().filter(F.col("dir") != ".").withColumnRenamed("dir", "_dir")
    probes = files.select("project_id", "rel", F.explode(text.path_prefixes("rel")).alias("_dir"))
    best = fact_join(probes, grown(dirs), ["project_id", "_dir"], "inner").groupBy("project_id", "rel").agg(
        F.max_by("_dir", F.length("_dir")).alias("scope"))
    out = files.join(grown(best), ["project_id", "rel"], "left")
    return out.withColumn("scope", F.coalesce("scope", F.lit(".")))


def path_inside_package(rel="rel") -> Column:
    """Path after the first dependency-directory marker."""
    c = text.col(rel)
    out = None
    for m in fixed.DEPENDENCY_DIRS:
        at = F.instr(c, m + "/")
        rest = F.substr(c, at + len(m) + 1)
        out = F.when(at > 0, rest) if out is None else out.when(at > 0, rest)
    return out.otherwise(c)


def owner_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(project_id, rel, scope) -> owner_id: the package whose name is the longest
    prefix of the path, one in the file's own scope first."""
    probes = files.withColumn("_rest", path_inside_package()).select(
        "project_id", "rel", F.col("scope").alias("_scope"), F.explode(text.path_prefixes("_rest")).alias("name"))
    named = packages.filter((F.col("kind") == "package") & (F.col("name") != "")).select(
        "project_id", "name", F.col("id").alias("owner_id"), F.col("scope").alias("_pscope"))
    hit = fact_join(probes, grown(named), ["project_id", "name"], "inner")
    order = F.struct((F.col("_pscope") != F.col("_scope")).alias("other"), (-F.length("name")).alias("len"), "owner_id")
    return hit.groupBy("project_id", "rel").agg(F.min_by("owner_id", order).alias("owner_id"))


def attach_vendored(licence_files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Licence texts inside dependency trees -> dependency rows after attachment.

    `licence_files`: (project_id, rel, scope, text_spdx), text_spdx NULL when not
    recognised. An unresolved package is filled from the first text it owns; a
    resolved one keeps its row and a separate vendored row carries what it
    declared; a text nobody owns stands alone.
    """
    known = licence_files.filter(F.col("text_spdx").isNotNull())
    owned = known.join(owner_of(known, dependencies), ["project_id", "rel"], "left")

    named = F.col("resolved") & (F.col("spdx") != "")
    fill = (
        owned.filter(F.col("owner_id").isNotNull()).groupBy("project_id", F.col("owner_id").alias("id"))
        .agg(F.min_by(F.struct("rel", "text_spdx"), "rel").alias("_fill"))
    )
    # at most one fill per package
    joined = dependencies.join(fill, ["project_id", "id"], "left")
    takes = ~named & F.col("_fill").isNotNull() & (F.col("kind") == "package")
    packages = joined.select(
        *[c for c in dependencies.columns if c not in ("spdx", "raw", "licence_source", "resolved", "expression", "licence_confidence")],
        *[F.when(takes, v).otherwise(F.col(c)).alias(c) for c, v in (
            ("spdx", F.col("_fill.text_spdx")), ("raw", F.col("_fill.text_spdx")), ("licence_source", F.lit("vendored_file")),
            ("resolved", F.lit(True)), ("expression", F.lit(False)), ("licence_confidence", F.lit("high")))],
    )
    base = dependencies.select("project_id", F.col("id").alias("owner_id"), *[F.col(c).alias(f"_{c}") for c in (
        "name", "version", "ecosystem", "scope", "direct", "spdx", "licence_source", "resolved")])
    rows = owned.join(base, ["project_id", "owner_id"], "left").join(
        fill.select("project_id", F.col("id").alias("owner_id"), F.col("_fill.rel").alias("_first")), ["project_id", "owner_id"], "left")
    was_named = F.coalesce(F.col("_resolved") & (F.col("_spdx") != ""), F.lit(False))
    used_as_fill = F.col("owner_id").isNotNull() & ~was_named & (F.col("rel") == F.col("_first"))
    # after the fill the package has a licence: later texts stand next to it
    declared = F.when(F.col("owner_id").isNull(), F.lit(None)).when(was_named, F.col("_spdx")).otherwise(F.col("_filled"))
    filled = fill.select("project_id", F.col("id").alias("owner_id"), F.col("_fill.text_spdx").alias("_filled"))
    extra = rows.join(filled, ["project_id", "owner_id"], "left").filter(~used_as_fill).select(
        "project_id", ids.local_id("vendored", "rel").alias("id"), F.lit("vendored").alias("kind"),
        F.coalesce("_name", text.dir_name("rel")).alias("name"), F.coalesce("_version", F.lit("")).alias("version"),
        F.coalesce("_ecosystem", F.lit("local")).alias("ecosystem"), F.coalesce("_scope", F.lit("")).alias("scope"),
        F.coalesce("_direct", F.lit(False)).alias("direct"), F.col("text_spdx").alias("spdx"), F.col("text_spdx").alias("raw"),
        F.lit("vendored_file").alias("licence_source"), F.lit(False).alias("expression"), F.lit(True).alias("resolved"),
        F.lit("high").alias("licence_confidence"), declared.alias("declared_licence"),
        F.col("rel").alias("evidence_path"), F.lit(0).alias("evidence_line"),
    )
    return packages.unionByName(extra, allowMissingColumns=True)


def unrecognised_texts(licence_files: DataFrame) -> DataFrame:
    return licence_files.filter(F.col("text_spdx").isNull()).select(
        "project_id", F.lit("E-SCAN-011").alias("code"), F.col("rel").alias("path"))
