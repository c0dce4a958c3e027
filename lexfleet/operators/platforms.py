"""Platform terms: detected signals matched to platforms by equi-joins."""

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import severity as sev, sqltext as q, text
from lexfleet.operators import predicates
from lexfleet.operators.evaluate import OUTCOME_COLUMNS, row_field
from lexfleet.session import fact_join, small_side


def token_dimension(spark, corpus) -> DataFrame:
    """(signal, key) -> platform. A platform's own slug answers every signal and
    goes first; a token claimed twice goes to the first platform in order."""
    tokens = corpus.frame(spark, "platform_tokens").select(
        "platform", "signal", F.lower("token").alias("key"), F.lit(1).alias("pass"))
    slugs = corpus.frame(spark, "platforms").select("platform", F.lower("platform").alias("key")).select(
        "platform", F.explode(F.array(*[F.lit(s) for s in ("bin", "runner", "host", "env", "import", "image")])).alias("signal"),
        "key", F.lit(0).alias("pass"))
    both = slugs.unionByName(tokens)
    return both.groupBy("signal", "key", "pass").agg(F.min("platform").alias("platform"))


def candidate_keys(signal, token):
    """Keys under which a token may be listed, the whole token first.

    A host also matches by any of its dot-suffixes, an import also by its last
    path segment: both become equi-join keys instead of a nested loop.
    """
    low = F.lower(F.trim(token))
    extra = (
        F.when(signal == "host", text.host_suffixes(low))
        .when((signal == "import") & low.contains("/"), F.array(F.element_at(F.split(low, "/"), -1)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.concat(F.array(low), extra))


def match_platforms(signals: DataFrame, corpus, key=("project_id", "id")) -> DataFrame:
    """Signals (…, signal, token) plus `platform`, NULL when nobody owns the token.

    Distinct (signal, token) pairs are matched once, then joined back: pages or
    call sites that share a host cost one lookup.
    """
    spark = signals.sparkSession
    pairs = signals.select("signal", "token").distinct()
    keyed = pairs.select("signal", "token", F.explode(candidate_keys(F.col("signal"), F.col("token"))).alias("key"))
    # a slug only answers for the whole token
    dim = token_dimension(spark, corpus)
    hit = keyed.join(small_side(dim), ["signal", "key"]).filter(
        (F.col("pass") == 1) | (F.col("key") == F.lower(F.trim("token"))))
    best = hit.groupBy("signal", "token").agg(F.min_by("platform", F.struct("pass", "platform")).alias("platform"))
    return fact_join(signals, best, ["signal", "token"], "left")


def signals_of(dependencies: DataFrame) -> DataFrame:
    """Upstream rows by their own signal, packages and vendored code by import name."""
    up = dependencies.filter(F.col("kind") == "upstream_cli").withColumn("token", F.col("name"))
    code = (
        dependencies.filter(F.col("kind").isin("package", "vendored"))
        .withColumn("token", F.col("name")).withColumn("signal", F.lit("import"))
    )
    return up.unionByName(code, allowMissingColumns=True)


def unmatched(matched: DataFrame) -> DataFrame:
    """An upstream signal nobody has terms for is a notice, never a finding."""
    noun = (
        F.when(F.col("signal") == "bin", "program").when(F.col("signal") == "runner", "package-runner invocation")
        .when(F.col("signal") == "host", "service").when(F.col("signal") == "env", "service credential")
        .when(F.col("signal") == "image", "container image").when(F.col("signal") == "import", "SDK").otherwise("dependency")
    )
    where = F.when(F.coalesce(F.col("evidence_path"), F.lit("")) == "", F.lit("an unknown location")).when(
        F.col("evidence_line") > 0, F.concat("evidence_path", F.lit(":"), F.col("evidence_line").cast("string"))
    ).otherwise(F.col("evidence_path"))
    message = F.concat(F.lit("no terms on record for "), noun, F.lit(" '"), "token", F.lit("' at "), where)
    return matched.filter((F.col("kind") == "upstream_cli") & F.col("platform").isNull()).select(
        "project_id", F.lit("E-CORPUS-004").alias("code"), message.alias("message"), "token", "signal")


def contributors(matched: DataFrame) -> DataFrame:
    """Per (project, platform): the smallest dependency id stands for all.
    Counts and minima only; the evidence stays in rows (see `platform_evidence`)."""
    first = F.struct("id", "kind", "name", "evidence_path", "evidence_line")
    return (
        matched.filter(F.col("platform").isNotNull())
        .groupBy("project_id", "platform")
        .agg(F.min_by(first, F.struct("id", "evidence_path", "evidence_line")).alias("primary"), F.count(F.lit(1)).alias("contributors"))
    )


def platform_evidence(matched: DataFrame) -> DataFrame:
    """Union of the contributors' evidence, distinct by place, one row each."""
    return matched.filter(F.col("platform").isNotNull()).select(
        "project_id", "platform", "evidence_path", "evidence_line").distinct()


def stale_notices(matched: DataFrame, corpus, today: str) -> DataFrame:
    spark = matched.sparkSession
    p = corpus.frame(spark, "platforms").filter(sev.platform_stale("last_verified", "staleness_days", today))
    used = matched.filter(F.col("platform").isNotNull()).select("project_id", "platform").distinct()
    return used.join(small_side(p), "platform").select(
        "project_id", F.lit("E-CORPUS-011").alias("code"),
        F.concat(F.lit("terms of "), "platform", F.lit(" last verified "), "last_verified", F.lit(", outside its "),
                 F.col("staleness_days").cast("string"), F.lit("-day window")).alias("message"))


def platform_outcomes(matched: DataFrame, intents: DataFrame, corpus, today: str) -> DataFrame:
    """One finding per clause of every platform a project uses. Only a clause that
    is definitely FALSE is left out: UNKNOWN still speaks."""
    spark = matched.sparkSession
    by_platform = fact_join(contributors(matched), intents, "project_id", "inner").select(
        "*", "primary.id", "primary.kind", "primary.name")

    def field(path):
        known = {"dep.kind": "kind", "dep.name": "name"}
        return known.get(path, "CAST(NULL AS STRING)") if path.startswith("dep.") else row_field(path)

    branches = []
    for p in corpus.platforms:
        hits = []
        for c in p.get("clauses", []):
            truth = predicates.compile_predicate(c.get("when", True), field).truth_sql
            hits.append(f"IF(coalesce({truth}, true), {q.quote(c['id'])}, NULL)")
        if hits:
            branches.append((f"platform = {q.quote(p['platform'])}", f"array_compact(array({', '.join(hits)}))"))
    fired = by_platform.select("*", F.explode(F.expr(q.case(branches))).alias("clause_id"))

    stale = sev.platform_stale("last_verified", "staleness_days", today)
    clauses = corpus.frame(spark, "platform_clauses").join(small_side(corpus.frame(spark, "platforms")), "platform")
    dim = clauses.select(
        "clause_id", "severity",
        F.when(stale, sev.downgrade_confidence("confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("platform_kind") == "binary", "third-party binary").otherwise("platform ToS").alias("licence"),
        F.concat("text_summary", F.lit(" (summary of the terms of "), "display_name", F.lit(", verified "), "last_verified",
                 F.lit(")"), F.when(stale, F.lit(" [stale]")).otherwise(F.lit(""))).alias("message"),
        "citation_url", "citation_section",
    )
    return fired.join(small_side(dim), "clause_id").select(
        "project_id", "intent_id", F.col("id").alias("dependency_id"), F.col("kind").alias("dep_kind"),
        F.col("name").alias("dep_name"), "licence", F.col("clause_id").alias("rule_id"), F.lit("platform").alias("source"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("undetermined_field"),
        "severity", "confidence", F.lit("platform terms of service").alias("title"), "message",
        "citation_url", "citation_section",
        F.col("primary.evidence_path").alias("evidence_path"), F.col("primary.evidence_line").alias("evidence_line"),
    ).select(*OUTCOME_COLUMNS)
