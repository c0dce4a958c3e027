"""Logical inputs derived from the star-schema test tables.

Every input is a deterministic map of the whole table, so a SQL engine can build
the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexfleet.functions import ids, sqltext as q, text
from lexfleet.operators.resolve import with_licence_ref
from lexfleet.session import small_side

TODAY = "2026-09-23"

# raw licence spelling of a part, by brand: ids, aliases, expressions, unknowns
BRAND_LICENCE = {
    "Brand#1": "MIT", "Brand#2": "MIT License", "Brand#3": "Apache 2.0", "Brand#4": "apache-2.0",
    "Brand#5": "BSD", "Brand#6": "ISC", "Brand#7": "MPL 2.0", "Brand#8": "LGPLv3", "Brand#9": "GPLv3",
    "Brand#10": "GPL-3.0+", "Brand#11": "AGPL-3.0", "Brand#12": "SSPL-1.0", "Brand#13": "Elastic-2.0",
    "Brand#14": "CC BY-NC 4.0", "Brand#15": "Llama-3.1-Community", "Brand#16": "BUSL-1.1",
    "Brand#17": "MIT OR Apache-2.0", "Brand#18": "see LICENSE", "Brand#19": "", "Brand#20": "CC0",
    "Brand#21": "mit", "Brand#22": "(GPL-2.0-only WITH Classpath-exception-2.0)",
    "Brand#23": "LicenseRef-Custom", "Brand#24": "Foo OR Bar", "Brand#25": "MPL-2.0+",
}
TYPE_ECOSYSTEM = {
    "STANDARD": "npm", "SMALL": "pypi", "MEDIUM": "go", "LARGE": "cargo", "ECONOMY": "local", "PROMO": "weights",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores before they become much work: a table's file is cut by its
    bytes, so a million parts in ten MB would be one task. The filter is always true and
    keeps others, with work in them, from moving below."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, key).filter(F.spark_partition_id() >= 0)


def shared(rows: DataFrame) -> DataFrame:
    """Rows that several steps of a query read: the filter, always true, keeps the steps' own
    filters above it, so what lies below is the same for all and is shuffled once."""
    return rows.filter(F.spark_partition_id() >= 0)


def _case(column, mapping):
    return F.expr(q.case((f"{column} = {q.quote(k)}", q.quote(v)) for k, v in mapping.items()))


def parts(spark, sf_dir) -> DataFrame:
    """Part -> package name, version, ecosystem, kind and raw licence."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "PROMO", "weights").when(F.col("p_type") == "ECONOMY", "vendored").otherwise("package")
    return p.select(
        "p_partkey",
        F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0.0")).alias("version"),
        _case("p_type", TYPE_ECOSYSTEM).alias("ecosystem"),
        kind.alias("kind"),
        _case("p_brand", BRAND_LICENCE).alias("licence_raw"),
    )


def part_dependencies(spark, sf_dir) -> DataFrame:
    """Every part as a package with its licence text resolved once."""
    p = with_licence_ref(parts(spark, sf_dir))
    vendored = F.col("kind") == "vendored"
    return (
        p.withColumn("licence_source", F.when(vendored, F.lit("vendored_file")).otherwise(F.col("licence_source")))
        .withColumn("id", ids.package_id("ecosystem", "name", "version"))
        .withColumn("declared_licence", F.when(vendored, F.lit("MIT")))
    )


def line_items(spark, sf_dir) -> DataFrame:
    """Line items as writes of one dependency each, in stage order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return li.withColumn("stage_seq", F.struct("l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"))


def edges(items: DataFrame, parts_df: DataFrame, more=()) -> DataFrame:
    """Dependency rows of line items, with some of their own columns."""
    return items.join(parts_df, items.l_partkey == parts_df.p_partkey).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"),
        "id", "kind", "name", "version", "ecosystem",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scope"),
        (F.col("l_linenumber") <= 3).alias("direct"),
        "spdx", "raw", "licence_source", "expression", "resolved", "licence_confidence", "declared_licence",
        F.concat(F.lit("lines/"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("evidence_path"),
        F.col("l_linenumber").cast("int").alias("evidence_line"), *more,
    )


def dependencies(spark, sf_dir) -> DataFrame:
    """One row per (project, id), last write wins. The id is one to one with the
    part key, so the upsert runs on narrow fixed-width rows before the wide join."""
    from lexfleet.operators.graph import upsert

    last = upsert(line_items(spark, sf_dir), keys=("l_orderkey", "l_partkey"))
    return edges(last, part_dependencies(spark, sf_dir))


def intents(spark, sf_dir) -> DataFrame:
    """One declared use per order."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region")
    j = (
        o.join(c, o.o_custkey == c.c_custkey).join(small_side(n), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(small_side(r), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    model = _case("c_mktsegment", {
        "FURNITURE": "closed-source", "MACHINERY": "open-source", "BUILDING": "source-available",
        "AUTOMOBILE": "dual", "HOUSEHOLD": "internal-only"})
    return j.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"),
        F.lit("declared").alias("intent_id"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("project_name"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("use_commercial"),
        model.alias("use_licence_model"),
        (F.col("o_orderstatus") == "F").alias("use_modified"),
        F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM").alias("use_network_exposed"),
        F.col("o_orderstatus").isin("O", "F").alias("use_distributed"),
        (F.col("c_mktsegment") == "MACHINERY").alias("use_saas"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") * 1000000).alias("scale_mau"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") % 5000).alias("scale_employees"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.floor("o_totalprice")).alias("scale_revenue_eur"),
        F.when(F.col("r_name") == "EUROPE", arr("EU", "GB")).when(F.col("r_name") == "AMERICA", arr("US"))
        .when(F.col("r_name") == "ASIA", arr("cn", "US")).when(F.col("r_name") == "AFRICA", arr("global"))
        .otherwise(F.array().cast("array<string>")).alias("territories"),
    )


def document_dependencies(spark, sf_dir) -> DataFrame:
    """Documents that state a licence, as vendored texts of their source.

    The detected id leaves through `explode`: a filter on it then stays above the
    text scan instead of repeating the text functions in a pushed-down copy.
    """
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.lower("text").alias("low"), text.normalise_text("text").alias("norm"))
    spdx = F.coalesce(text.recognise_licence("norm"), text.prose_licence("low"))
    found = d.select(F.col("source").alias("project_id"), "doc_id", F.explode(F.array_compact(F.array(spdx))).alias("spdx"))
    return found.select(
        "project_id",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("vendored").alias("kind"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.lit("").alias("version"), F.lit("local").alias("ecosystem"), F.lit(".").alias("scope"), F.lit(True).alias("direct"),
        "spdx", F.col("spdx").alias("raw"), F.lit("vendored_file").alias("licence_source"), F.lit(False).alias("expression"),
        F.lit(True).alias("resolved"), F.lit("high").alias("licence_confidence"),
        F.lit(None).cast("string").alias("declared_licence"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("evidence_path"), F.lit(0).alias("evidence_line"),
    )


INTENT_TYPES = {
    "use_commercial": "boolean", "use_licence_model": "string", "use_modified": "boolean", "use_network_exposed": "boolean",
    "use_distributed": "boolean", "use_saas": "boolean", "scale_mau": "long", "scale_employees": "long",
    "scale_revenue_eur": "long", "territories": "array<string>",
}


def literal_intents(projects: DataFrame, facts: dict) -> DataFrame:
    """The same declared uses for every project: intent_id -> {column: value}.
    A fact left out is undeclared."""
    def column(name, f):
        value = f.get(name, [] if name == "territories" else None)
        c = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        return c.cast(INTENT_TYPES[name]).alias(name)

    rows = [F.struct(F.lit(i).alias("intent_id"), *[column(n, f) for n in INTENT_TYPES]) for i, f in facts.items()]
    return projects.select("project_id", F.inline(F.array(*rows))).withColumn("project_name", F.col("project_id"))
