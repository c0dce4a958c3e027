"""Dependency rows: upsert, conversion of declarations, scan statistics."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import ids, severity as sev, text


# Orders of the parts of a report, applied when a document is built.
DEPENDENCY_ORDER = ["kind", "name", "version", "id"]
DECLARED_ORDER = ["ecosystem", "name", "version"]
UNDETERMINED_ORDER = ["kind", "id"]
WARNING_ORDER = ["code", "path", "message"]
NOTICE_ORDER = ["code", "message"]


def in_order(rows: DataFrame, order, keys=("project_id",)) -> DataFrame:
    """Adds position, from 1, inside each project by one of the orders above."""
    from lexfleet.operators.ranking import ordinal_within

    return ordinal_within(rows, list(keys), order, "position").withColumn("position", F.col("position").cast("long"))


def upsert(rows: DataFrame, keys=("project_id", "id"), order="stage_seq") -> DataFrame:
    """Last write per key wins. A `max_by` aggregate combines on the map side, so
    an id repeated millions of times is not sorted in one task."""
    keep = [c for c in rows.columns if c not in (*keys, order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.col(order)).alias("_last"))
    return last.select(*keys, "_last.*")


def stays_inside(directory, path):
    """True when directory/path does not climb out of the project root."""
    joined = F.concat(text.col(directory), F.lit("/"), F.regexp_replace(text.col(path), r"\\", "/"))
    step = F.transform(F.split(joined, "/"), lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))
    low = F.aggregate(step, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.least(acc["low"], acc["at"] + x).alias("low")),
                      lambda acc: acc["low"])
    return low >= 0


def metadata(**entries):
    """Map of the entries that are set: true flags and non-empty strings."""
    pairs = []
    for k, c in entries.items():
        pairs += [F.lit(k), c]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def to_dependencies(chosen: DataFrame) -> DataFrame:
    """Chosen declarations -> dependency rows.

    A local path inside the project is part of it and no dependency; one outside
    stays and says so. `chosen` carries dir and source next to the declared columns.
    """
    from lexfleet.operators.resolve import with_licence_ref

    inside = stays_inside("dir", "path_dep")
    rows = chosen.filter((F.col("name") != "") & (~F.col("local") | ((F.col("path_dep") != "") & ~inside)))
    flag = lambda c: F.when(c, F.lit("true"))
    rows = with_licence_ref(rows, "licence_raw", F.col("source"))
    return rows.select(
        "project_id", ids.package_id("ecosystem", "name", "version").alias("id"), F.lit("package").alias("kind"), "name", "version", "ecosystem",
        F.col("dir").alias("scope"), "direct", "spdx", "raw", "licence_source", "expression", "resolved", "licence_confidence",
        F.lit(None).cast("string").alias("declared_licence"), F.col("source_path").alias("evidence_path"), F.col("line").alias("evidence_line"),
        metadata(dev=flag(F.col("dev")), optional=flag(F.col("optional")), version_is_requirement=flag(F.col("is_range")),
                 path_dependency=flag(F.col("local")), path=F.when(F.col("local"), F.col("path_dep")),
                 outside_root=flag(F.col("local"))).alias("metadata"))


def weakest_provenance(rows: DataFrame, keys, column="provenance") -> DataFrame:
    """Weakest class of each group; an unknown class is the weakest of all."""
    return rows.groupBy(*keys).agg(F.min_by(F.col(column), F.struct(sev.provenance_rank(column), F.col(column))).alias(column))
