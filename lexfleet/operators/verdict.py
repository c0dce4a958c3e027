"""The verdict fold and its counts: partial aggregates, so a hot project is
combined on the map side and one row per task reaches the shuffle."""

from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.functions import severity as sev

KEYS = ["project_id", "intent_id"]


def with_effective_severity(outcomes: DataFrame, allow_medium_blockers=False) -> DataFrame:
    eff = sev.effective_severity("severity", "confidence", allow_medium_blockers)
    return outcomes.withColumn("effective_severity", F.when(F.col("rule_id").isNotNull(), eff))


def outcome_rank(effective=None, reason=None) -> Column:
    """3 blocks, 2 is unknown, 1 is a condition, 0 nothing to say."""
    effective = F.col("effective_severity") if effective is None else effective
    reason = F.col("reason") if reason is None else reason
    return F.greatest(
        F.when(effective == "BLOCK", 3).when(effective == "CONDITION", 1).otherwise(0),
        F.when(reason.isNotNull(), 2).otherwise(0),
    )


def fold(outcomes: DataFrame, projects: DataFrame, allow_medium_blockers=False) -> DataFrame:
    """One verdict per (project, intent); a project without outcomes ships.

    Projects join the fold as rows that say nothing, so one aggregate answers for
    all of them and no join follows. Outcomes of collapsed dependencies carry a
    `weight`, the number of dependencies they speak for.
    """
    eff = F.col("effective_severity")
    one = F.lit(1).cast("long")
    weight = F.coalesce("weight", one) if "weight" in outcomes.columns else one
    said = with_effective_severity(outcomes, allow_medium_blockers).select(*KEYS, "effective_severity", "reason", weight.alias("weight"))
    silent = projects.select(*KEYS, F.lit(None).cast("string").alias("effective_severity"), F.lit(None).cast("string").alias("reason"),
                             F.lit(0).cast("long").alias("weight"))
    number = lambda condition: F.sum(F.when(condition, F.col("weight")).otherwise(0))
    counts = said.unionByName(silent).groupBy(*KEYS).agg(
        F.max(outcome_rank()).alias("rank"),
        number(eff == "BLOCK").alias("blockers"),
        number(eff == "CONDITION").alias("conditions"),
        number(eff.isin("NOTE", "INFO")).alias("notes"),
        number(F.col("reason").isNotNull()).alias("undetermined"),
    )
    return counts.select(*KEYS, sev.verdict_from_rank(F.col("rank")).alias("verdict"), "blockers", "conditions", "notes", "undetermined")


def dependency_counts(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("dependencies"),
        F.count_if(F.col("kind") == "weights").alias("weight_files"),
        F.count_if(F.col("kind") == "upstream_cli").alias("upstream_clis"),
    )


def exit_code(verdict, strict=False, fail_on="BLOCK") -> Column:
    """0 passes, 1 fails, 5 is `could not tell` under strict. `fail_on` is a
    severity: a verdict at least that strong fails."""
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    threshold = {"BLOCK": 3, "CONDITION": 2, "NOTE": 1, "INFO": 1}[fail_on.strip().upper()]
    weight = F.when(v == "DO_NOT_SHIP", 3).when(v.isin("SHIP_CONDITIONAL", "UNDETERMINED"), 2).otherwise(0)
    unsure = F.when(v == "UNDETERMINED", F.lit(5 if strict else 0)).otherwise(0)
    return F.when(v == "DO_NOT_SHIP", 1).when(weight >= threshold, 1).otherwise(unsure)
