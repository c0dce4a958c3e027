"""Organisation policy over findings: exceptions, escalations, deny lists, gates.

Policy runs on declared severity before the confidence gate, so it can never
raise a guess to a blocker.
"""

import json

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import severity as sev, spdx as spdx_fn, ids
from lexfleet.operators import predicates
from lexfleet.operators.evaluate import OUTCOME_COLUMNS
from lexfleet.operators.resolve import licence_dimension
from lexfleet.session import local_frame, fact_join, small_side

MAX_CONDITIONS = 1000
EXCEPTION_SCHEMA = "ordinal int, dependency string, kind string, reason string, owner string, expires string"
ESCALATION_SCHEMA = "target_type string, target string, severity string"


def policy_tables(spark, policy: dict):
    """A parsed policy document as its two tables (bounded: hand-written rules)."""
    ex = [(i, e["dependency"], e.get("kind") or None, e["reason"], e["owner"], e["expires"])
          for i, e in enumerate(policy.get("exceptions", []))]
    esc = [(t, k, v) for t, block in (("family", "families"), ("licence", "licences"))
           for k, v in (policy.get("escalate", {}).get(block) or {}).items()]
    return local_frame(spark, ex, EXCEPTION_SCHEMA), local_frame(spark, esc, ESCALATION_SCHEMA)


def _scoped(df: DataFrame) -> DataFrame:
    """A policy without organisations is that of one organisation without a name."""
    return df if "org" in df.columns else df.withColumn("org", F.lit(""))


def first_exception(exceptions: DataFrame) -> DataFrame:
    """Per (org, dependency, kind-or-any): the first rule. Two rules can then apply to
    a finding at most, and the smaller ordinal decides."""
    e = _scoped(exceptions).select("org", "ordinal", "dependency", F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.lit("*")).alias("ex_kind"),
                          F.struct("ordinal", "owner", "expires", "reason").alias("rule"))
    return e.groupBy("org", "dependency", "ex_kind").agg(F.min_by("rule", "ordinal").alias("rule"))


def match_exceptions(outcomes: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Adds `exception` (struct or NULL): the first rule of the finding's organisation
    for (dependency, kind?).

    One equi-join on the dependency, whose rules stand in one row: the one for any kind and a
    map by kind (bounded: hand-written) of those that come before it. Findings cross one shuffle
    and are not multiplied; the rule leaves through `explode`, which looks it up once.
    """
    named, first = F.col("ex_kind") != "*", first_exception(exceptions)
    rules = first.groupBy("org", F.col("dependency").alias("dependency_id")).agg(
        F.max(F.when(~named, F.col("rule"))).alias("_any"), F.collect_list(F.when(named, F.struct("ex_kind", "rule"))).alias("_named"))
    before = lambda x: F.col("_any").isNull() | (x["rule"]["ordinal"] < F.col("_any.ordinal"))
    rules = rules.select("org", "dependency_id", "_any", F.map_from_entries(F.filter("_named", before)).alias("_kinds"))
    pick = F.when(F.col("rule_id").isNotNull(), F.coalesce(F.try_element_at("_kinds", F.col("rule_id")), "_any"))
    out = outcomes.join(rules, ["org", "dependency_id"], "left")
    return out.select(*[c for c in out.columns if c not in ("_any", "_kinds")], F.explode(F.array(pick)).alias("exception"))


def _strongest(escalations, target_type, key):
    rows = _scoped(escalations).filter(F.col("target_type") == target_type)
    return rows.select("org", F.lower(F.trim("target")).alias(key), sev.severity_weight(F.upper(F.trim("severity"))).alias(f"{key}_w")).groupBy(
        "org", key).agg(F.max(f"{key}_w").alias(f"{key}_w"))


def apply_policy(outcomes: DataFrame, corpus, exceptions: DataFrame, escalations: DataFrame, today: str, orgs: DataFrame = None) -> DataFrame:
    """Rewrites declared severity by the policy of each project's organisation: `orgs` is
    (project_id, org), and both policy tables have `org` then. Projects without an
    organisation have no policy. A live exception demotes to NOTE; an expired one
    changes nothing, leaves a notice and still shields from escalation."""
    spark = outcomes.sparkSession
    dim = licence_dimension(spark, corpus, "pol_").select("pol_key", F.lower("pol_family").alias("pol_family"))
    label = F.trim("licence")
    is_id = (label != "") & ~label.rlike(r"[ \t]")
    owned = outcomes.join(orgs.select("project_id", "org"), "project_id", "left") if orgs is not None else outcomes.withColumn("org", F.lit(""))
    joined = (
        match_exceptions(owned, exceptions)
        .withColumn("pol_key", spdx_fn.lookup_key("licence"))
        .join(small_side(dim), "pol_key", "left")
        .join(_strongest(escalations, "family", "pol_family"), ["org", "pol_family"], "left")
        .withColumn("pol_licence", F.when(is_id, F.lower(label)))
        .join(_strongest(escalations, "licence", "pol_licence"), ["org", "pol_licence"], "left")
    )
    live = sev.exception_live("exception.expires", today)
    has = F.col("exception").isNotNull()
    raised = F.greatest(F.coalesce("pol_family_w", F.lit(0)), F.coalesce("pol_licence_w", F.lit(0)))
    raises = F.col("rule_id").isNotNull() & ~has & (raised > sev.severity_weight("severity"))
    decision = F.when(has & live, "excepted").when(has, "expired").when(raises, "raised")
    keep = [c for c in outcomes.columns if c not in ("severity",)]
    return joined.select(
        *keep,
        F.when(has & live, F.lit("NOTE")).when(raises, sev.severity_from_weight(raised)).otherwise(F.col("severity")).alias("severity"),
        F.col("severity").alias("corpus_severity"), decision.alias("policy_decision"),
        F.col("exception.owner").alias("exception_owner"), F.col("exception.expires").alias("exception_expires"),
    )


def expired_notices(applied: DataFrame) -> DataFrame:
    return applied.filter(F.col("policy_decision") == "expired").select(
        "project_id", "intent_id", F.lit("E-CFG-012").alias("code"),
        F.concat(F.lit("exception for "), "dependency_id", F.lit(" owned by "), "exception_owner", F.lit(" expired on "),
                 "exception_expires").alias("message"))


def deny_list(dependencies: DataFrame, intents: DataFrame, denied: DataFrame) -> DataFrame:
    """Dependencies whose licence a project never allows: BLOCK at HIGH confidence.
    `denied` is (project_id, licence), compared after normalising both."""
    never = denied.select("project_id", spdx_fn.lookup_key("licence").alias("_deny")).distinct()
    hit = dependencies.withColumn("_deny", spdx_fn.lookup_key("spdx")).join(never, ["project_id", "_deny"], "left_semi")
    judged = fact_join(hit, intents.select("project_id", "intent_id"), "project_id", "inner")
    null = F.lit(None).cast("string")
    return judged.select(
        "project_id", "intent_id", F.col("id").alias("dependency_id"), F.col("kind").alias("dep_kind"), F.col("name").alias("dep_name"),
        ids.licence_label("spdx", "raw").alias("licence"), F.lit("policy.never_allow").alias("rule_id"), F.lit("policy").alias("source"),
        null.alias("reason"), null.alias("undetermined_field"), F.lit("BLOCK").alias("severity"), F.lit("HIGH").alias("confidence"),
        F.lit("licence on the deny list").alias("title"), F.lit("this project never allows the licence").alias("message"),
        null.alias("citation_url"), null.alias("citation_section"), "evidence_path", "evidence_line",
    ).select(*OUTCOME_COLUMNS)


def gate_on(outcomes: DataFrame, block_on: DataFrame) -> DataFrame:
    """Findings whose effective severity their project blocks on. `block_on` is
    (project_id, block_on), a list per project; without one a project blocks on BLOCK."""
    lists = block_on.select("project_id", "block_on").filter(F.size("block_on") > 0)
    judged = outcomes.filter(F.col("rule_id").isNotNull()).join(lists, "project_id", "left")
    stops = F.array_contains(F.coalesce("block_on", F.array(F.lit("BLOCK"))), F.col("effective_severity"))
    return judged.filter(stops).drop("block_on")


def allowed(allow_if: DataFrame, intents: DataFrame) -> DataFrame:
    """(project_id, intent_id, licence) of allowances whose condition is TRUE for the
    intent. A null or empty `when` always holds; UNKNOWN does not.

    Conditions are compiled into the plan, each different text once; there are
    MAX_CONDITIONS at most."""
    texts = [r[0] for r in allow_if.select("when").filter(F.coalesce("when", F.lit("")) != "").distinct().limit(MAX_CONDITIONS + 1).collect()]
    if len(texts) > MAX_CONDITIONS:
        raise ValueError(f"over {MAX_CONDITIONS} different conditions")
    truth = F.when(F.coalesce("when", F.lit("")) == "", True)
    for text in sorted(texts):
        tree = json.loads(text)
        if any(f.startswith("dep.") for f in predicates.fields_of(tree)):
            raise ValueError(f"a condition on a dependency: {text}")
        truth = truth.when(F.col("when") == text, predicates.compile_predicate(tree).truth)
    both = allow_if.select("project_id", "licence", "when").join(intents, "project_id")
    return both.filter(F.coalesce(truth, F.lit(False))).select("project_id", "intent_id", "licence")


def waive(outcomes: DataFrame, allow_if: DataFrame, intents: DataFrame) -> DataFrame:
    """Marks findings whose licence the project allows for the intent; a waived finding
    stays visible as a note. `allow_if` is (project_id, licence, when), `when` the JSON
    of a predicate over the intent."""
    ok = allowed(allow_if, intents).select("project_id", "intent_id", spdx_fn.lookup_key("licence").alias("_allow")).distinct().withColumn("_waived", F.lit(True))
    joined = outcomes.withColumn("_allow", spdx_fn.lookup_key("licence")).join(ok, ["project_id", "intent_id", "_allow"], "left")
    waived = F.coalesce("_waived", F.lit(False)) & F.col("rule_id").isNotNull()
    return joined.withColumn("severity", F.when(waived, F.lit("NOTE")).otherwise(F.col("severity"))).withColumn("waived", waived).drop("_allow", "_waived")
