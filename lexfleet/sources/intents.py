"""Declared intents: documents, overlay of project over user defaults, policy files."""

from pyspark.sql import DataFrame, functions as F

INTENT_FACTS = [
    "project_name", "use_commercial", "use_licence_model", "use_modified", "use_network_exposed", "use_distributed", "use_saas",
    "scale_mau", "scale_employees", "scale_revenue_eur", "territories",
]
DOCUMENT_SCHEMA = (
    "struct<schema_version:int,project:struct<name:string>,"
    "use:struct<commercial:boolean,licence_model:string,modified:boolean,network_exposed:boolean,distributed:boolean,saas:boolean>,"
    "scale:struct<mau:bigint,employees:bigint,revenue_eur:bigint>,territories:array<string>,"
    "policy:struct<never_allow:array<string>,allow_if:array<struct<licence:string,when:string>>,block_on:array<string>,"
    "ignore:array<struct<path:string,reason:string>>>>"
)


def read_documents(files: DataFrame, base_name="config") -> DataFrame:
    """(project_id, rel, text) intent documents as JSON -> one wide row each.
    A fact left out stays NULL: undeclared, never guessed."""
    d = files.withColumn("d", F.from_json("text", DOCUMENT_SCHEMA))
    name = F.coalesce(F.nullif(F.trim("d.project.name"), F.lit("")), F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]*$", ""))
    return d.select(
        "project_id", F.lit("declared").alias("intent_id"), name.alias("project_name"),
        *[F.col(f"d.use.{c}").alias(f"use_{c}") for c in ("commercial", "licence_model", "modified", "network_exposed", "distributed", "saas")],
        *[F.col(f"d.scale.{c}").alias(f"scale_{c}") for c in ("mau", "employees", "revenue_eur")],
        F.coalesce("d.territories", F.array().cast("array<string>")).alias("territories"),
        F.col("d.policy").alias("policy"))


def overlay(project: DataFrame, user: DataFrame, facts=INTENT_FACTS) -> DataFrame:
    """Project facts over user defaults, field by field. `user` has one row per project."""
    u = user.select("project_id", *[F.col(c).alias(f"_u_{c}") for c in facts])
    j = project.join(u, "project_id", "left")
    both = lambda c: F.col(c).isNotNull() & F.col(f"_u_{c}").isNotNull() & (F.col(c) != F.col(f"_u_{c}"))
    overridden = F.array_compact(F.array(*[F.when(both(c), F.lit(c)) for c in facts]))
    rest = [c for c in project.columns if c not in facts]
    return j.select(*rest, *[F.coalesce(c, f"_u_{c}").alias(c) for c in facts], overridden.alias("overridden"))


def override_notices(merged: DataFrame) -> DataFrame:
    return merged.select("project_id", F.lit("E-CFG-009").alias("code"), F.explode("overridden").alias("field"))


def ignore_rows(documents: DataFrame) -> DataFrame:
    return documents.select("project_id", F.posexplode("policy.ignore").alias("ordinal", "r")).select("project_id", "ordinal", "r.path", "r.reason")


def deny_rows(documents: DataFrame) -> DataFrame:
    return documents.select("project_id", F.explode("policy.never_allow").alias("licence"))


POLICY_SCHEMA = (
    "struct<schema_version:int,org:string,escalate:struct<families:map<string,string>,licences:map<string,string>>,"
    "exceptions:array<struct<dependency:string,kind:string,reason:string,owner:string,expires:string>>>"
)


def policy_rows(files: DataFrame):
    """(org, text) organisation policies as JSON -> (exceptions, escalations) tables."""
    p = files.withColumn("p", F.from_json("text", POLICY_SCHEMA))
    exceptions = p.select("org", F.posexplode("p.exceptions").alias("ordinal", "e")).select("org", "ordinal", "e.*")
    families = p.select("org", F.lit("family").alias("target_type"), F.explode("p.escalate.families").alias("target", "severity"))
    licences = p.select("org", F.lit("licence").alias("target_type"), F.explode("p.escalate.licences").alias("target", "severity"))
    return exceptions, families.unionByName(licences)
