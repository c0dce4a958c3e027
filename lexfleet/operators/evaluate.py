"""Rule evaluation over dependency x intent rows, in one pass.

Every rule is compiled into the plan. A row yields an array of outcome structs
(one CASE branch per licence, so only its own obligations are evaluated) and
`inline` turns them into rows: no rescan per rule, no join of rows with rules.

An outcome row is a finding when `rule_id` is set and an undetermined item when
`reason` is set; an obligation that could not be decided is both.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.functions import ids, severity as sev, sqltext as q
from lexfleet.operators import predicates
from lexfleet.operators.resolve import resolve
from lexfleet.session import fact_join, opened, pinned, small_side, stepped

USE_FACTS = ["commercial", "licence_model", "modified", "network_exposed", "distributed", "saas"]
SCALE_FACTS = ["mau", "employees", "revenue_eur"]
OUTCOME_COLUMNS = [
    "project_id", "intent_id", "dependency_id", "dep_kind", "dep_name", "licence",
    "rule_id", "source", "reason", "undetermined_field",
    "severity", "confidence", "title", "message", "citation_url", "citation_section",
    "evidence_path", "evidence_line",
]
_STRUCT = "struct<rule_id:string,source:string,reason:string,field:string>"
_EMPTY = f"CAST(array() AS array<{_STRUCT}>)"


def evaluation_rows(dependencies: DataFrame, intents: DataFrame, corpus) -> DataFrame:
    """Dependencies with their licence entry and every intent of their project."""
    return fact_join(resolve(dependencies, corpus), intents, "project_id", "inner")


def rule_fields(corpus) -> set:
    """Predicate fields that any rule of the corpus reads."""
    rules = list(corpus.traps)
    for e in corpus.licences:
        rules += e.get("obligations", []) + e.get("traps", [])
    return {f for r in rules for f in predicates.fields_of(r.get("when", True))}


def collapse(dependencies: DataFrame, corpus) -> DataFrame:
    """Dependencies that no rule can tell apart as one row with their number.

    Verdicts need counts, not names. Grouping on the facts the rules read combines
    on the map side, so a project with a billion dependencies crosses the shuffle as
    a few rows per licence and kind. The columns a finding would name are left empty.
    """
    optional = {"dep.ecosystem": "ecosystem", "dep.name": "name", "dep.version": "version"}
    read = [c for f, c in optional.items() if f in rule_fields(corpus)]
    keys = ["project_id", "kind", "spdx", "resolved", *read]
    out = dependencies.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))
    empty = [c for c in ("id", "name", "version", "ecosystem", "raw", "evidence_path") if c not in keys]
    return out.select(*keys, "weight", *[F.lit("").alias(c) for c in empty], F.lit(0).alias("evidence_line"))


IS_NAMED = "(coalesce(resolved, false) AND coalesce(spdx, '') <> '')"


def row_field(path: str) -> str:
    """SQL of a predicate field: NULL exactly when the fact is undeclared."""
    special = {
        "dep.kind": "kind",
        "dep.ecosystem": "ecosystem",
        "dep.name": "name",
        "dep.version": "nullif(version, '')",
        "dep.licence.family": "entry_family",
        "dep.licence.permissiveness": "entry_permissiveness",
        "dep.licence.spdx": "coalesce(spdx, '')",
        "dep.licence.resolved": IS_NAMED,
        "project.name": "nullif(project_name, '')",
    }
    return special.get(path) or q.ident(predicates.column_name(path))


def _struct(rule_id, source, reason="NULL", field="NULL") -> str:
    return (f"named_struct('rule_id', CAST({q.quote(rule_id)} AS STRING), 'source', CAST({q.quote(source)} AS STRING), "
            f"'reason', CAST({reason} AS STRING), 'field', CAST({field} AS STRING))")


def _obligation(rule, column_sql) -> str:
    c = predicates.compile_predicate(rule.get("when", True), column_sql)
    if c.field_sql == predicates.NO_FIELD:
        return f"array({_struct(rule['id'], 'obligation')})"
    reason = f"IF({c.truth_sql} IS NULL, 'intent_undeclared', NULL)"
    return f"IF(coalesce({c.truth_sql}, true), array({_struct(rule['id'], 'obligation', reason, c.field_sql)}), {_EMPTY})"


def _trap(rule, source, column_sql) -> str:
    c = predicates.compile_predicate(rule.get("when", True), column_sql)
    return f"IF({c.truth_sql}, array({_struct(rule['id'], source)}), {_EMPTY})"


def outcome_array(corpus, column_sql=row_field) -> Column:
    """Array of outcome structs of one evaluation row.

    A rule gives an array of one struct or none, and `flatten` joins them. A function with a
    lambda (`array_compact` is one) would run the rules below it as interpreted expressions.
    """
    empty, own = _EMPTY, []
    for e in corpus.licences:
        hits = [_obligation(o, column_sql) for o in e.get("obligations", [])]
        hits += [_trap(t, "own_trap", column_sql) for t in e.get("traps", [])]
        if hits:
            own.append((f"entry_spdx = {q.quote(e['spdx_id'])}", f"flatten(array({', '.join(hits)}))"))
    own_hits = q.case(own, empty)
    traps = [_trap(t, "trap", column_sql) for t in corpus.dependency_traps()]
    traps = f"flatten(array({', '.join(traps)}))" if traps else empty

    licensed = "kind NOT IN ('asset', 'upstream_cli')"
    unnamed = _struct(None, None, f"IF({IS_NAMED}, 'no_corpus_entry', 'licence_unresolved')")
    missing = f"IF({licensed} AND (entry_spdx IS NULL OR NOT {IS_NAMED}), array({unnamed}), {empty})"
    own_hits = f"IF({licensed} AND {IS_NAMED} AND entry_spdx IS NOT NULL, {own_hits}, {empty})"
    return F.expr(f"IF(kind <> 'upstream_cli', concat({missing}, {own_hits}, {traps}), {empty})")


def rule_dimension(spark, corpus, today: str) -> DataFrame:
    """Rule attributes, with confidence already lowered where the citation is stale."""
    d = corpus.frame(spark, "rules")
    lowered = F.when(
        sev.citation_stale("citation_retrieved_at", today), sev.downgrade_confidence("confidence")
    ).otherwise(F.col("confidence"))
    return d.select(
        "rule_id", "severity", lowered.alias("confidence"), "title", "message", "citation_url", "citation_section",
        "obligation_kind", "when_text",
    )


def evaluate(rows: DataFrame, corpus, today: str, shared=False) -> DataFrame:
    """Outcome rows of obligations, own traps and catalogue traps, plus the rows
    that could not be decided. `shared` outcomes are read by several steps, which then
    share the shuffles below."""
    spark = rows.sparkSession
    weight = ["weight"] if "weight" in rows.columns else []
    made = stepped(rows, "kind", _hits=outcome_array(corpus))
    if shared:
        read = ["project_id", "intent_id", "id", "kind", "spdx", "raw", "evidence_path", "evidence_line", "_hits", "_one"]
        made = pinned(made, *read, *weight)
    hits = made.select(
        "project_id", "intent_id", *weight,
        F.col("id").alias("dependency_id"), F.col("kind").alias("dep_kind"), F.col("name").alias("dep_name"),
        ids.licence_label("spdx", "raw").alias("licence"),
        "evidence_path", "evidence_line",
        F.inline(opened("_hits")),
    )
    unknown = F.col("field").isNotNull()
    joined = hits.join(small_side(rule_dimension(spark, corpus, today)), "rule_id", "left")
    return joined.select(
        "project_id", "intent_id", "dependency_id", "dep_kind", "dep_name", "licence",
        "rule_id", "source", "reason", F.col("field").alias("undetermined_field"),
        F.when(unknown, F.lit("NOTE")).otherwise(F.col("severity")).alias("severity"),
        F.when(unknown, F.lit("LOW")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(unknown, F.concat("title", F.lit(" (undetermined)"))).otherwise(F.col("title")).alias("title"),
        "message", "citation_url", "citation_section", "evidence_path", "evidence_line", *weight,
    )


def outcomes_in_row(rows: DataFrame, corpus, today: str, allow_medium_blockers=False) -> DataFrame:
    """Adds `outcomes`, the outcome rows that `evaluate` makes of a row as an array of
    (rule_id, reason, rule: (severity, confidence, citation_url, effective_severity)), NULL
    when there are none. Nothing is exploded, so nothing has to be grouped again. The corpus
    is bounded: its rules are a map inside the plan."""
    facts = ["severity", "confidence", "citation_url", "effective_severity"]
    rule, doubt = rule_dimension(rows.sparkSession, corpus, today), {"severity": F.lit("NOTE"), "confidence": F.lit("LOW")}
    gate = sev.effective_severity("severity", "confidence", allow_medium_blockers)
    known, unknown = [d.withColumn("effective_severity", gate).select("rule_id", *facts).collect() for d in (rule, rule.withColumns(doubt))]
    by_id = lambda said: F.create_map(*[c for r in said for c in (F.lit(r.rule_id), F.struct(*[F.lit(r[f]).cast("string").alias(f) for f in facts]))])
    known, unknown = by_id(known), by_id(unknown)
    said = F.transform("_hits", lambda x: F.struct(
        x["rule_id"].alias("rule_id"), x["reason"].alias("reason"), F.when(x["field"].isNull(), known[x["rule_id"]]).otherwise(unknown[x["rule_id"]]).alias("rule")))
    # The rules are one step of their own: read twice, they are not moved into the lambda, and
    # a lambda beside them (`_one`) makes the step small methods, which the JVM compiles; as a
    # part of one whole-stage method they are too large for that.
    step = rows.withColumns({"_hits": outcome_array(corpus), "_one": F.transform(F.array("kind"), lambda k: k)})
    return step.withColumn("outcomes", F.when(F.size("_hits") >= F.size("_one"), said)).drop("_hits", "_one")


def merge(*outcomes: DataFrame) -> DataFrame:
    """Outcome rows of several layers, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outcomes)


def findings(outcomes: DataFrame) -> DataFrame:
    found = outcomes.filter(F.col("rule_id").isNotNull())
    return found.withColumn("finding_id", ids.finding_id("dependency_id", "rule_id"))


def undetermined_id() -> Column:
    """An undecided obligation is `dependency#obligation`."""
    return F.when(F.col("rule_id").isNotNull(), F.concat("dependency_id", F.lit("#"), "rule_id")).otherwise(F.col("dependency_id"))


def error_code() -> Column:
    return (
        F.when(F.col("reason") == "licence_unresolved", "E-SCAN-011")
        .when(F.col("reason") == "no_corpus_entry", "E-POLICY-001")
        .when(F.col("reason") == "intent_undeclared", "E-POLICY-009")
        .when(F.col("reason") == "licence_not_found", "E-SCAN-010")
    )


def undetermined(outcomes: DataFrame) -> DataFrame:
    """One row per undecided item."""
    return outcomes.filter(F.col("reason").isNotNull()).select(
        "project_id", "intent_id", undetermined_id().alias("id"), F.col("dep_kind").alias("kind"), "reason",
        "undetermined_field", error_code().alias("error_code"), "evidence_path", "evidence_line",
    )


def notices(outcomes: DataFrame) -> DataFrame:
    """What the run wants said: undeclared facts and licences without an entry."""
    message = (
        F.when(F.col("reason") == "intent_undeclared", F.concat(F.lit("undeclared: "), "undetermined_field"))
        .when(F.col("reason") == "no_corpus_entry", F.concat(F.lit("no entry for "), "licence", F.lit(" ("), "dependency_id", F.lit(")")))
    )
    code = F.when(F.col("reason") == "intent_undeclared", "E-POLICY-009").otherwise("E-POLICY-001")
    return (
        outcomes.filter(F.col("reason").isin("intent_undeclared", "no_corpus_entry"))
        .select("project_id", "intent_id", code.alias("code"), message.alias("message"))
    )
