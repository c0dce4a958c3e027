"""Platform-terms queries on the hosts of `pages`."""

from functools import lru_cache

from pyspark.sql import functions as F

from lexfleet.functions import text as tx
from lexfleet.operators import platforms as pf, verdict as vd
from lexfleet.plans import bindings as b
from lexfleet.plans.registry import query
from lexfleet.rules import loader


def _clause(cid, severity, confidence, when=True):
    return {"id": cid, "severity": severity, "confidence": confidence, "text_summary": cid, "when": when,
            "citation": {"url": "https://example.com/terms", "section": cid}}


@lru_cache(maxsize=1)
def corpus():
    """Terms for two of the three domains and, more narrowly, for one mobile host."""
    commercial = {"op": "==", "field": "use.commercial", "value": True}
    mau = {"op": ">", "field": "scale.mau", "value": 1000}
    return loader.build({"platforms": [
        {"platform": "alpha", "display_name": "Alpha", "kind": "hosted-service", "last_verified": "2026-09-01", "staleness_days": 180,
         "detect": {"hosts": ["example.com"]},
         "clauses": [_clause("alpha.resale", "BLOCK", "HIGH", commercial), _clause("alpha.scale", "CONDITION", "MEDIUM", mau),
                     _clause("alpha.note", "NOTE", "LOW")]},
        {"platform": "beta", "display_name": "Beta", "kind": "platform", "last_verified": "2025-01-01", "staleness_days": 180,
         "detect": {"hosts": ["example.net"]},
         "clauses": [_clause("beta.terms", "BLOCK", "HIGH"), _clause("beta.private", "CONDITION", "MEDIUM",
                     {"op": "not", "x": commercial})]},
        {"platform": "zeta", "display_name": "Zeta", "kind": "binary", "last_verified": "not a date", "staleness_days": 1,
         "detect": {"hosts": ["m.therou.example.com", "example.net"]}, "clauses": [_clause("zeta.binary", "CONDITION", "HIGH")]},
    ]})


def signals(spark, sf):
    """A page is a host signal of the project named by the language in its path."""
    p = b.table(spark, sf, "pages").select("page_id", "url")
    return p.select(
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("project_id"),
        F.concat(F.lit("upstream_cli:"), F.col("page_id").cast("string")).alias("id"), F.lit("upstream_cli").alias("kind"),
        tx.url_host("url").alias("name"), tx.url_host("url").alias("token"), F.lit("host").alias("signal"),
        F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("evidence_path"), F.lit(1).alias("evidence_line"))


def intents(spark, sf):
    projects = signals(spark, sf).select("project_id").distinct()
    shared = {"use_licence_model": "closed-source", "use_modified": False, "use_network_exposed": True, "use_distributed": False, "use_saas": True}
    return b.literal_intents(projects, {"paid": {**shared, "use_commercial": True, "scale_mau": 10}, "free": {**shared, "use_commercial": False}})


def matched(spark, sf):
    return pf.match_platforms(signals(spark, sf), corpus())


@query
def platform_hosts(spark, sf):
    return matched(spark, sf).select("project_id", "id", "token", "platform")


@query
def platform_rollup(spark, sf):
    c = pf.contributors(matched(spark, sf))
    e = pf.platform_evidence(matched(spark, sf)).groupBy("project_id", "platform").agg(F.count(F.lit(1)).alias("places"))
    return c.join(e, ["project_id", "platform"]).select(
        "project_id", "platform", F.col("primary.id").alias("primary_id"), "contributors", "places")


@query
def platform_clauses(spark, sf):
    o = vd.with_effective_severity(pf.platform_outcomes(matched(spark, sf), intents(spark, sf), corpus(), b.TODAY))
    return o.select("project_id", "intent_id", "dependency_id", "rule_id", "licence", "severity", "confidence", "effective_severity")


@query
def platform_verdicts(spark, sf):
    i = intents(spark, sf)
    return vd.fold(pf.platform_outcomes(matched(spark, sf), i, corpus(), b.TODAY), i)


@query
def unknown_platforms(spark, sf):
    return pf.unmatched(matched(spark, sf)).select("project_id", "code", "signal", "token", "message")


@query
def stale_platforms(spark, sf):
    return pf.stale_notices(matched(spark, sf), corpus(), b.TODAY)
