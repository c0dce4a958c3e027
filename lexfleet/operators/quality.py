"""Checks on inputs: every check yields rows (subject, problem), never a silent drop."""

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from lexfleet.functions import fixed, severity as sev, spdx as spdx_fn, text as tx
from lexfleet.session import ensure_checkpoint_dir


def violations(df: DataFrame, subject, checks: dict, keep=()) -> DataFrame:
    """One row per failed check, all checks in one pass. A NULL check counts as failed."""
    cells = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.select(*keep, subject.alias("subject"), F.explode(cells).alias("problem"))


def _filled(c) -> Column:
    return F.trim(F.coalesce(tx.col(c), F.lit(""))) != ""


def _known(c, values) -> Column:
    return F.coalesce(tx.col(c).isin(list(values)), F.lit(False))


def not_future(c, today) -> Column:
    """A readable date that is not after today."""
    return F.coalesce(sev.parse_date(c) <= sev.parse_date(F.lit(today)), F.lit(False))


def _citation_ok(prefix="citation_") -> Column:
    excerpt, kind = F.coalesce(F.col(f"{prefix}excerpt"), F.lit("")), F.coalesce(F.col(f"{prefix}excerpt_kind"), F.lit(""))
    worded = F.when(excerpt == "", kind == "").otherwise(kind.isin(fixed.EXCERPT_KINDS))
    return _filled(f"{prefix}url") & _filled(f"{prefix}section") & (F.length(excerpt) <= fixed.CITATION_EXCERPT_CHARS) & worded


def dependencies(df: DataFrame) -> DataFrame:
    """Rows (project_id, id, evidence_path) that break the graph's promises, then
    ids that occur twice in a project."""
    path = F.col("evidence_path")
    single = violations(df, F.col("id"), {
        "no id": _filled("id"), "no evidence": _filled(path),
        "evidence outside the project": ~F.coalesce(path, F.lit("")).startswith("/") & ~F.coalesce(path, F.lit("")).contains(".."),
    }, ["project_id"])
    twice = df.groupBy("project_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return single.unionByName(twice.select("project_id", F.col("id").alias("subject"), F.lit("duplicate id").alias("problem")))


def licence_checks(today: str) -> dict:
    """Checks of licence entries (columns of the licence dimension) and their corrections."""
    corrected = F.col("correction_reason").isNotNull() | F.col("correction_from").isNotNull()
    correction = ~corrected | (
        _filled("correction_reason") & _filled("correction_evidence") & _filled("corrected_at") & _filled("corrected_by")
        & _known("correction_from", fixed.CONFIDENCE_WEIGHT) & _known("correction_to", fixed.CONFIDENCE_WEIGHT)
        & (sev.confidence_weight("correction_to") > sev.confidence_weight("correction_from")))
    return {
        "no identifier": _filled("licence_id") & _filled("spdx_id"), "unknown family": _known("family", fixed.FAMILIES),
        "permissiveness": F.col("permissiveness").between(1, 5), "confidence": _known("entry_confidence", fixed.CONFIDENCE_WEIGHT),
        "citation": _citation_ok(), "last verified": not_future("last_verified", today), "correction": correction,
        # an entry keyed by an alias could not be found under its own name
        "alias as identifier": spdx_fn.lookup_key("spdx_id") == F.upper(F.trim("spdx_id")),
    }


def licences(df: DataFrame, today: str) -> DataFrame:
    """Rows (subject, problem) of licence entries."""
    return violations(df, F.col("licence_id"), licence_checks(today))


def rules(df: DataFrame) -> DataFrame:
    """Obligations and traps (columns of the rule dimension)."""
    obligation = F.col("source") == "obligation"
    length = F.length(F.trim("message"))
    scope = F.coalesce("scope", F.lit("dependency"))
    single = violations(df, F.col("rule_id"), {
        "no identifier": _filled("rule_id"), "severity": _known("severity", fixed.SEVERITY_WEIGHT),
        "confidence": _known("confidence", fixed.CONFIDENCE_WEIGHT), "citation": _citation_ok(),
        "message": ~obligation | length.between(10, 600), "title": obligation | _filled("title"),
        "obligation kind": ~obligation | _known("obligation_kind", fixed.OBLIGATION_BANDS),
        "fix action": F.col("fix_action").isNull() | _known("fix_action", fixed.FIX_ACTIONS),
        "fix confidence": F.col("fix_action").isNull() | _known("fix_confidence", fixed.CONFIDENCE_WEIGHT),
        "scope": scope.isin("dependency", "graph") & ((scope != "graph") | (F.col("source") == "trap")),
    })
    twice = df.groupBy(F.coalesce("spdx_key", F.lit("")).alias("owner"), "rule_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return single.unionByName(twice.select(F.col("rule_id").alias("subject"), F.lit("duplicate id").alias("problem")))


def severity_bands(df: DataFrame) -> DataFrame:
    """Obligations whose severity is unusual for their kind: a report, not an error."""
    usual = reduce(lambda a, kv: a.when(F.col("obligation_kind") == kv[0], F.col("severity").isin(kv[1])),
                   list(fixed.OBLIGATION_BANDS.items())[1:],
                   F.when(F.col("obligation_kind") == "ATTRIBUTION", F.col("severity").isin(fixed.OBLIGATION_BANDS["ATTRIBUTION"])))
    return df.filter((F.col("source") == "obligation") & ~F.coalesce(usual, F.lit(True))).select("rule_id", "obligation_kind", "severity")


def platforms(platform_df: DataFrame, tokens: DataFrame, clauses: DataFrame, today: str) -> DataFrame:
    p = violations(platform_df, F.col("platform"), {
        "no slug": _filled("platform"), "no name": _filled("display_name"),
        "kind": F.coalesce(F.col("platform_kind"), F.lit("")).isin("", *fixed.PLATFORM_KINDS),
        "last verified": not_future("last_verified", today), "staleness window": F.col("staleness_days") > 0})
    t = violations(tokens, F.col("platform"), {"blank token": _filled("token"), "signal": _known("signal", fixed.PLATFORM_SIGNALS)})
    c = violations(clauses, F.col("clause_id"), {
        "severity": _known("severity", fixed.SEVERITY_WEIGHT), "confidence": _known("confidence", fixed.CONFIDENCE_WEIGHT),
        "summary": F.length(F.trim("text_summary")).between(10, 600), "citation": _citation_ok()})
    return p.unionByName(t).unionByName(c)


def territory_gates(gates: DataFrame) -> DataFrame:
    return violations(gates, F.col("gate_id"), {
        "no territory": _filled("territory"), "severity": _known("severity", fixed.SEVERITY_WEIGHT),
        "confidence": _known("confidence", fixed.CONFIDENCE_WEIGHT), "citation": _citation_ok()})


def citations(df: DataFrame) -> DataFrame:
    """(url, section, excerpt, excerpt_kind)."""
    named = df.select("*", *[F.col(c).alias(f"citation_{c}") for c in ("url", "section", "excerpt", "excerpt_kind")])
    return violations(named, F.concat_ws("#", "url", "section"), {"citation": _citation_ok()})


def exceptions(df: DataFrame) -> DataFrame:
    return violations(df, F.col("ordinal").cast("string"), {
        "no dependency": _filled("dependency"), "no reason": _filled("reason"), "no owner": _filled("owner"),
        "no expiry": _filled("expires"), "expiry is no date": ~_filled("expires") | sev.parse_date(F.trim("expires")).isNotNull()})


def escalations(df: DataFrame) -> DataFrame:
    """A policy may raise to CONDITION or BLOCK; NOTE would lower everything it names."""
    s = F.upper(F.trim("severity"))
    family = F.col("target_type") == "family"
    return violations(df, F.col("target"), {
        "no target": _filled("target"), "unknown family": ~family | _known("target", fixed.FAMILIES),
        "not a severity": s.isin("BLOCK", "CONDITION", "NOTE"), "may not lower": s != "NOTE"})


def intents(df: DataFrame) -> DataFrame:
    """Intent rows: required facts, vocabulary, territories."""
    required = {f"undeclared {c}": F.col(c).isNotNull() for c in (
        "use_commercial", "use_licence_model", "use_modified", "use_network_exposed", "use_distributed", "use_saas")}
    return violations(df, F.concat_ws("/", "project_id", "intent_id"), {
        **required, "licence model": F.col("use_licence_model").isNull() | _known("use_licence_model", fixed.LICENCE_MODELS),
        "territory": F.forall(F.coalesce("territories", F.array().cast("array<string>")), lambda t: tx.valid_territory(t))})


def ignore_rules(df: DataFrame) -> DataFrame:
    """(project_id, path, reason): a reason is needed, and neither everything nor a lockfile may be hidden."""
    p = F.regexp_replace(F.regexp_replace(F.trim("path"), r"\\", "/"), r"/\*\*?$", "")
    base = F.element_at(F.split(p, "/"), -1)
    return violations(df, F.concat_ws(":", "project_id", "path"), {
        "no reason": _filled("reason"), "hides everything": ~p.isin("", ".", "/"), "hides a lockfile": ~base.isin(fixed.LOCKFILE_NAMES)})


def allow_rules(df: DataFrame) -> DataFrame:
    """(project_id, licence): a waiver names one licence, never all of them."""
    name = F.lower(F.trim("licence"))
    return violations(df, F.concat_ws(":", "project_id", "licence"), {
        "waives everything": ~name.isin("", "*", "all", "any", "everything") & ~name.rlike(r"[*?]")})


class DataError(ValueError):
    """Rows that break a check. metrics: rows, bad, first and the failures of each check."""

    def __init__(self, metrics: dict):
        super().__init__(f"{metrics['first']} ({metrics['bad']} of {metrics['rows']} rows)")
        self.metrics = metrics


def watched(df: DataFrame, subject: Column, checks: dict):
    """Writes `df` to the shared checkpoint folder and counts, in the same pass, the rows
    that break each check: (what was written, metrics). A NULL check counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    seen, bad = Observation(f"checks-{uuid.uuid4().hex}"), F.size("_failed") > 0
    metrics = [F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.concat(F.coalesce(F.col("_subject"), F.lit("")), F.lit(": "), F.get("_failed", F.lit(0))))).alias("first")]
    metrics += [F.count_if(F.array_contains("_failed", name)).alias(f"check {name}") for name in checks]
    ensure_checkpoint_dir(df.sparkSession)
    place = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/checked-{uuid.uuid4().hex}"
    marked = df.select("*", subject.cast("string").alias("_subject"), failed.alias("_failed")).observe(seen, *metrics)
    marked.drop("_subject", "_failed").write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place), seen.get


def checked(df: DataFrame, subject: Column, checks: dict) -> DataFrame:
    """`df` as written, or DataError when a row breaks a check. Nothing is joined to the
    rows, and they are read once."""
    written, metrics = watched(df, subject, checks)
    if metrics["bad"]:
        raise DataError(metrics)
    return written


def require_clean(problems: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` unchanged, or DataError when a table of problems (subject, problem) is not empty."""
    found = problems.agg(F.count(F.lit(1)).alias("bad"), F.min(F.concat_ws(": ", "subject", "problem")).alias("first")).first()
    if found.bad:
        raise DataError({"rows": found.bad, "bad": found.bad, "first": found.first})
    return rows
