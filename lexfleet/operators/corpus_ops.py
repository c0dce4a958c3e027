"""Questions about rule corpora themselves, as aggregates and joins on their tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import severity as sev, spdx as spdx_fn
from lexfleet.operators.ranking import ordinal_within
from lexfleet.session import fact_join, local_frame, small_side


def citation_index(citations: DataFrame) -> DataFrame:
    """(url, section) -> first registration in load order, and whether excerpts disagree."""
    body = F.struct(F.coalesce("excerpt", F.lit("")).alias("excerpt"), F.coalesce("excerpt_kind", F.lit("")).alias("excerpt_kind"))
    first = F.min_by(F.struct("owner", "excerpt", "excerpt_kind"), "load_order")
    # two distinct values exist exactly when the smallest and the largest differ
    return citations.groupBy("url", "section").agg(
        first.alias("first"), (F.min(body) != F.max(body)).alias("conflict"), F.count(F.lit(1)).alias("uses")
    ).select("url", "section", "first.*", "conflict", "uses")


def missing_citations(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Findings whose clause is not on record; must be empty for a sound corpus."""
    known = citations.select(F.col("url").alias("citation_url"), F.col("section").alias("citation_section")).distinct()
    return findings.join(small_side(known), ["citation_url", "citation_section"], "left_anti")


def require_cited(findings: DataFrame, citations: DataFrame) -> DataFrame:
    """Findings unchanged; the job fails when one of them cites nothing on record."""
    known = citations.select(F.col("url").alias("citation_url"), F.col("section").alias("citation_section")).distinct().withColumn("_ok", F.lit(True))
    joined = findings.join(small_side(known), ["citation_url", "citation_section"], "left")
    problem = F.concat(F.lit("uncited finding "), "dependency_id", F.lit(" "), "rule_id")
    return joined.filter(F.when(F.col("_ok").isNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))).drop("_ok")


CLAIMANTS = 1000  # on a page


def token_claims(tokens: DataFrame, page_size=CLAIMANTS) -> DataFrame:
    """(signal, token) claimed by more than one platform, with all claimants in pages:
    signal, token, platforms (how many), page (from 0), claimants (in order).

    Positions come from range slices, so a token that everybody claims spreads over
    as many tasks and rows as it has pages."""
    t = tokens.select("signal", F.lower("token").alias("token"), "platform").distinct()
    shared = t.groupBy("signal", "token").agg(F.count(F.lit(1)).alias("platforms")).filter("platforms > 1")
    claimed = fact_join(t, shared, ["signal", "token"], "inner")
    placed = ordinal_within(claimed, ["signal", "token"], ["platform"], "_pos").withColumn("page", F.floor((F.col("_pos") - 1) / page_size))
    return placed.groupBy("signal", "token", "platforms", "page").agg(F.array_sort(F.collect_list("platform")).alias("claimants"))


def confidence_rises(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entries (spdx, confidence[, correction_from]) that became more certain between
    versions, and whether a correction record explains it."""
    o = old.select(spdx_fn.lookup_key("spdx").alias("_k"), F.col("confidence").alias("old_confidence"))
    n = new.withColumn("_k", spdx_fn.lookup_key("spdx"))
    j = n.join(o, "_k")
    rose = sev.confidence_weight("confidence") > sev.confidence_weight("old_confidence")
    explained = F.coalesce(F.col("correction_from") == F.col("old_confidence"), F.lit(False))
    return j.filter(rose).select("spdx", "old_confidence", "confidence", explained.alias("explained"))


def corpus_tables(spark, corpus) -> dict:
    """The tables of a corpus that `corpus_stats` counts."""
    rules = corpus.frame(spark, "rules")
    return {
        "licences": corpus.frame(spark, "licences").select(F.col("family").alias("part"), F.col("spdx_id").alias("key")),
        "obligations": rules.filter("source = 'obligation'").select(F.col("obligation_kind").alias("part"), F.col("rule_id").alias("key")),
        "traps": rules.filter("source <> 'obligation'").select(F.col("severity").alias("part"), F.col("rule_id").alias("key")),
        "platforms": corpus.frame(spark, "platforms").select(F.col("platform_kind").alias("part"), F.col("platform").alias("key")),
        "territories": corpus.frame(spark, "territory_gates").select(F.col("severity").alias("part"), F.col("territory").alias("key")),
        "citations": corpus.frame(spark, "citations").select(F.lit("").alias("part"), F.concat_ws("#", "url", "section").alias("key")),
    }


def corpus_stats(tables: dict) -> DataFrame:
    """Counts of a corpus: what, part, entries (rows), keys (different ones). tables: what ->
    rows (part, key).

    The tables are one tagged union; GROUPING SETS give the rows of every part, of every
    table (part is null) and of all (both null) in one pass."""
    tagged = reduce(lambda a, b: a.unionByName(b), (t.select(F.lit(what).alias("what"), F.coalesce("part", F.lit("")).alias("part"), F.col("key").cast("string").alias("key")) for what, t in tables.items()))
    sets = [[F.col("what"), F.col("part")], [F.col("what")], []]
    return tagged.groupingSets(sets, "what", "part").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("what", "key").alias("keys"))


def entry_stats(entries: DataFrame) -> DataFrame:
    """Entries, obligations and distinct clauses per family of a table of entries
    (family, spdx, obligations, url, section)."""
    return entries.groupBy("family").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("obligations").alias("obligations"), F.count_distinct("url", "section").alias("citations"))


def licence_lookup(keys: DataFrame, corpus) -> DataFrame:
    """A batch of licence names -> their entries and rule counts (unknown names stay, NULL)."""
    spark = keys.sparkSession
    rules = corpus.frame(spark, "rules").filter(F.col("spdx_key").isNotNull()).groupBy("spdx_key").agg(
        F.count_if(F.col("source") == "obligation").alias("obligations"))
    entry = corpus.frame(spark, "licences").join(rules, "spdx_key", "left")
    return keys.withColumn("spdx_key", spdx_fn.lookup_key("licence")).join(small_side(entry), "spdx_key", "left").drop("spdx_key")


def citation_lookup(keys: DataFrame, corpus) -> DataFrame:
    """`url#section` keys -> who cites the clause first."""
    index = citation_index(corpus.frame(keys.sparkSession, "citations")).withColumn("citation", F.concat("url", F.lit("#"), "section"))
    return keys.join(small_side(index), "citation", "left")


def territory_report(intents: DataFrame, corpus) -> DataFrame:
    """Gates of every declared territory: information only, never part of a verdict."""
    gates = corpus.frame(intents.sparkSession, "territory_gates").select("territory", "gate_id", F.col("severity").alias("gate_severity"))
    t = intents.select("project_id", "intent_id", F.explode("territories").alias("_t")).withColumn("territory", F.upper(F.trim("_t")))
    return t.join(small_side(gates), "territory").select("project_id", "intent_id", "territory", "gate_id", "gate_severity").distinct()


# What to do about an undecided item, by error code; anything else gets the fallback.
RECOVERY = [
    ("E-SCAN-010", "add a licence statement next to the weight file"),
    ("E-SCAN-011", "read the licence text and declare its identifier"),
    ("E-POLICY-001", "add an entry for this licence to the corpus"),
    ("E-POLICY-009", "declare the missing fact"),
]
FALLBACK = "supply the missing fact, or remove the file from the scan"


def with_recovery(undetermined: DataFrame) -> DataFrame:
    table = local_frame(undetermined.sparkSession, RECOVERY, "error_code string, action string")
    j = undetermined.join(small_side(table), "error_code", "left")
    return j.withColumn("action", F.coalesce("action", F.lit(FALLBACK)))
