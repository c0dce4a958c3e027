"""Model suggestions: parsed, admitted against findings, never allowed to change them."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import spdx as spdx_fn, text as tx
from lexfleet.operators.resolve import licence_dimension
from lexfleet.session import small_side

ANSWER_SCHEMA = (
    "struct<job:string,findings:array<struct<id:string,explanation:string>>,"
    "remediation:array<struct<finding_id:string,action:string,effort:string,alternative:string>>,"
    "triage:array<struct<id:string,read_first:string,why:string>>,"
    "overrides:array<struct<finding_id:string,op:string,severity:string,confidence:string>>>"
)
ITEM_COLUMNS = ["kind", "item_id", "body", "effort", "alternative", "op"]


def parse_answers(answers: DataFrame) -> DataFrame:
    """(project_id, seq, job, text) -> one row per suggested item.

    A text that is no JSON object, or that answers another job, yields nothing
    here and one row in `rejected_answers`.
    """
    p = _parsed(answers).filter(F.col("problem").isNull())
    null = F.lit(None).cast("string")

    def items(kind, array, item):
        return F.transform(F.coalesce(array, F.array()), lambda x: item(x, F.lit(kind)))

    def cell(kind, item_id, body, effort=null, alternative=null, op=null):
        return F.struct(kind.alias("kind"), F.trim(item_id).alias("item_id"), body.alias("body"), effort.alias("effort"),
                        alternative.alias("alternative"), op.alias("op"))

    level = lambda e: F.when(F.lower(F.trim(e)).isin("low", "medium", "high"), F.lower(F.trim(e))).otherwise(F.lit(""))
    everything = F.concat(
        items("explanation", F.col("a.findings"), lambda x, k: cell(k, x["id"], tx.clip_text(x["explanation"]))),
        items("remediation", F.col("a.remediation"), lambda x, k: cell(k, x["finding_id"], tx.clip_text(F.coalesce(x["action"], F.lit(""))), level(F.coalesce(x["effort"], F.lit(""))),
                                                                      tx.clip_text(F.coalesce(x["alternative"], F.lit(""))))),
        items("triage", F.col("a.triage"), lambda x, k: cell(k, x["id"], tx.clip_text(F.coalesce(x["read_first"], F.lit(""))))),
        items("override", F.col("a.overrides"), lambda x, k: cell(k, F.coalesce(x["finding_id"], F.lit("")), F.lit(""), op=F.lower(F.trim(F.coalesce(x["op"], F.lit("")))))),
    )
    rows = p.select("project_id", "seq", "job", F.posexplode(everything).alias("pos", "i")).select("project_id", "seq", "job", "pos", "i.*")
    named = F.coalesce(F.col("item_id"), F.lit("")) != ""
    worded = (F.col("kind") != "explanation") | (F.coalesce(F.col("body"), F.lit("")) != "")
    return rows.filter(((F.col("kind") == "override") | named) & worded)


def _parsed(answers):
    raw = answers.withColumn("_t", tx.strip_code_fence("text"))
    is_object = F.schema_of_variant(F.try_parse_json("_t")).startswith("OBJECT")
    p = raw.withColumn("a", F.from_json("_t", ANSWER_SCHEMA))
    claimed = F.coalesce(F.nullif(F.trim("a.job"), F.lit("")), F.col("job"))
    problem = (
        F.when(F.col("_t") == "", "the answer is empty")
        .when(~F.coalesce(is_object, F.lit(False)), "the answer is no JSON object")
        .when(claimed != F.col("job"), "the answer is for another job")
    )
    return p.withColumn("problem", problem)


def rejected_answers(answers: DataFrame) -> DataFrame:
    return _parsed(answers).filter(F.col("problem").isNotNull()).select("project_id", "seq", "job", F.lit("E-AI-005").alias("code"), F.col("problem").alias("message"))


def admit(items: DataFrame, finding_ids: DataFrame, undetermined_ids: DataFrame) -> DataFrame:
    """Items about known ids. Both id tables are (project_id, item_id)."""
    known = finding_ids.select("project_id", "item_id").distinct()
    open_ids = undetermined_ids.select("project_id", "item_id").distinct()
    about = items.filter(F.col("kind").isin("explanation", "remediation")).join(known, ["project_id", "item_id"], "left_semi")
    triage = items.filter(F.col("kind") == "triage").join(open_ids, ["project_id", "item_id"], "left_semi")
    return about.unionByName(triage)


def refused(items: DataFrame, finding_ids: DataFrame, undetermined_ids: DataFrame) -> DataFrame:
    """A notice per item that was not admitted; attempts to change findings always are."""
    known = finding_ids.select("project_id", "item_id").distinct()
    open_ids = undetermined_ids.select("project_id", "item_id").distinct()
    unknown = items.filter(F.col("kind").isin("explanation", "remediation")).join(known, ["project_id", "item_id"], "left_anti")
    triage = items.filter(F.col("kind") == "triage").join(open_ids, ["project_id", "item_id"], "left_anti")
    dropped = unknown.unionByName(triage).select("project_id", "item_id", F.lit("E-AI-005").alias("code"), F.concat(F.lit("unknown id for "), "kind").alias("message"))
    verb = (
        F.when(F.col("op").isin("add", "create"), "add").when(F.col("op").isin("remove", "delete", "suppress"), "remove")
        .when(F.col("op").isin("severity", "confidence"), F.concat(F.lit("change the "), "op")).otherwise("alter"))
    attempts = items.filter(F.col("kind") == "override").select(
        "project_id", F.when(F.col("item_id") == "", "(no id given)").otherwise(F.col("item_id")).alias("item_id"),
        F.lit("E-AI-006").alias("code"), F.concat(F.lit("refused to "), verb).alias("message"))
    return dropped.unionByName(attempts)


def alternative_licence(c):
    """Licence named in the last brackets of a suggestion, else the whole text."""
    t = F.trim(tx.col(c))
    inner = F.trim(F.regexp_extract(t, r"(?s)\(([^(]*)\)[^)]*$", 1))
    return F.when(inner != "", inner).otherwise(t)


def verify_alternatives(items: DataFrame, corpus) -> DataFrame:
    """Adds `verified`: nothing suggested, or the suggested licence has an entry."""
    dim = licence_dimension(items.sparkSession, corpus, "alt_").select("alt_key", "alt_spdx")
    j = items.withColumn("alt_key", spdx_fn.lookup_key(alternative_licence("alternative"))).join(small_side(dim), "alt_key", "left")
    return j.withColumn("verified", (F.trim("alternative") == "") | F.col("alt_spdx").isNotNull()).drop("alt_key", "alt_spdx")


def merge(items: DataFrame) -> DataFrame:
    """One item per (project, kind, id): the first answer's. An aggregate, so an id
    repeated by many answers is combined before the shuffle."""
    keep = [c for c in items.columns if c not in ("project_id", "kind", "item_id")]
    m = items.groupBy("project_id", "kind", "item_id").agg(F.min_by(F.struct(*keep), F.struct("seq", "pos")).alias("_m"))
    return m.select("project_id", "kind", "item_id", "_m.*")


def payload_rows(findings: DataFrame, undetermined: DataFrame, job: str, redact=True) -> DataFrame:
    """What an explanation request may carry: rows of JSON, one per item, names redacted,
    paths only when they are relative and stay inside the project."""
    name = F.lit("the project") if redact else F.coalesce(F.nullif(F.trim("project_id"), F.lit("")), F.lit("the project"))
    paths = lambda: tx.safe_paths(F.array(F.coalesce("evidence_path", F.lit(""))))
    f = findings.select("project_id", "intent_id", F.col("finding_id").alias("item_id"), F.to_json(F.struct(
        F.lit(job).alias("job"), name.alias("project"), F.col("finding_id").alias("id"), F.col("dependency_id").alias("dependency"),
        F.col("rule_id").alias("kind"), "severity", "confidence", "licence", "title", F.col("message").alias("reason"),
        "citation_url", "citation_section", paths().alias("evidence_paths"))).alias("payload"))
    u = undetermined.select("project_id", "intent_id", F.col("id").alias("item_id"), F.to_json(F.struct(
        F.lit(job).alias("job"), name.alias("project"), "id", "kind", "reason", "error_code", paths().alias("evidence_paths"))).alias("payload"))
    # triage is about what could not be decided, the other jobs are about findings
    return u if job == "triage" else f
