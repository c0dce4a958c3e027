"""Rule evaluation, policy and verdict queries on the order/line-item binding."""

import json
from functools import lru_cache

from pyspark.sql import functions as F

from lexfleet.functions import fixed, ids, severity as sev, spdx as spdx_fn, text
from lexfleet.operators import crosscheck, evaluate as ev, graph, orgpolicy, predicates, resolve as rs, verdict as vd
from lexfleet.plans import bindings as b
from lexfleet.plans.registry import query
from lexfleet.rules import loader
from lexfleet.session import local_frame

FINDING = ["project_id", "intent_id", "dependency_id", "rule_id", "severity", "confidence", "effective_severity"]


@lru_cache(maxsize=1)
def corpus():
    return loader.load()


def inputs(spark, sf):
    return b.dependencies(spark, sf), b.intents(spark, sf)


def rows(spark, sf):
    return ev.evaluation_rows(*inputs(spark, sf), corpus())


def rule_outcomes(spark, sf, shared=False):
    return ev.evaluate(rows(spark, sf), corpus(), b.TODAY, shared)


def all_outcomes(deps, intents):
    """Rules and both cross checks over the same inputs."""
    resolved = rs.resolve(deps, corpus())
    return ev.merge(
        ev.evaluate(ev.evaluation_rows(deps, intents, corpus()), corpus(), b.TODAY),
        crosscheck.weights_divergence(resolved, intents, corpus()),
        crosscheck.declared_vs_actual(resolved, intents, corpus()),
    )


@query
def verdict_by_source(spark, sf):
    """Verdict per source of documents, from what their texts say about licensing."""
    deps = b.document_dependencies(spark, sf)
    facts = {"ship": {"use_commercial": True, "use_licence_model": "closed-source", "use_modified": False,
                      "use_network_exposed": False, "use_distributed": True, "use_saas": False}}
    projects = b.table(spark, sf, "documents").select(F.col("source").alias("project_id")).distinct()
    intents = b.literal_intents(projects, facts)
    outcomes = ev.evaluate(ev.evaluation_rows(deps, intents, corpus()), corpus(), b.TODAY)
    return vd.fold(outcomes, intents)


@query
def licence_prose(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    return d.select("doc_id", text.prose_needle("low").alias("needle"), text.prose_licence("low").alias("spdx"))


# BD-7: phrases put in front of every document, chosen by its id; one choice is none.
PHRASES = [
    "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007",
    "GNU Lesser General Public License\n\tVersion 3, 29 June 2007",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",
    "Server Side Public License", "Elastic License 2.0", "Business Source License 1.1",
    "Mozilla Public License Version 2.0", "Apache License\n Version 2.0, January 2004",
    "Attribution-NonCommercial 4.0 International", "Creative Commons Attribution 4.0 International",
    "CC0 1.0 Universal",
    "Redistribution and use in source and binary forms ... Neither the name of the holder",
    "Redistribution and use in source and binary forms are permitted",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Permission is hereby granted, free of charge, to any person obtaining a copy ... without warranty of any kind",
    "Altered source versions must be plainly marked as such",
    "This is free and unencumbered software released into the public domain",
    "",
]
BRAND_PHRASES = [
    "This licence does not grant permission to use the trade names or logo.",
    "The trademark may be shown by anyone.",
    "Some parts are reserved by their authors and are not covered here.",
    "All product names remain the property of their owners.",
    "",
]


def injected(spark, sf, phrases):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    chosen = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return d.select("doc_id", F.concat(chosen, F.lit("\n"), F.col("text")).alias("text"))


@query
def licence_recognise(spark, sf):
    norm = injected(spark, sf, PHRASES).select("doc_id", text.normalise_text("text").alias("norm"))
    return norm.select("doc_id", F.length("norm").alias("norm_chars"), F.sha2("norm", 256).alias("norm_sha"),
                       text.recognise_licence("norm").alias("spdx"))


@query
def brand_reservation(spark, sf):
    d = injected(spark, sf, BRAND_PHRASES)
    norm = d.select("doc_id", "text", text.normalise_text("text").alias("norm"))
    return norm.select("doc_id", text.has_brand_noun("norm").alias("noun"),
                       text.has_brand_reservation("norm").alias("reserved"))


# raw licence spellings, chosen per part
SPELLINGS = [
    "MIT", " MIT License ", "mit", "Mit", "Apache-2", "APACHE-2.0", "GPLv2", "gpl-3.0-ONLY", "LGPL-2.1", "New BSD",
    "FreeBSD", "Public Domain", "CC BY 4.0", "proprietary", "MPL-2.0+", "GPL-2.0+", "LicenseRef-", "LicenseRef-x",
    "licenseref-Y", "MIT or ISC", "MIT AND (ISC OR Zlib)", "MIT OR Nope", " OR ", "WTFPL", "openrail++-m",
    "SEE LICENSE IN LICENSE", "none", "", "unknown words", "BSD 2-Clause",
]


@query
def spdx_normalise(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey")
    raw = F.element_at(F.array(*[F.lit(s) for s in SPELLINGS]), (F.col("p_partkey") % len(SPELLINGS) + 1).cast("int"))
    ref = spdx_fn.licence_ref("raw", "manifest")
    out = p.select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", spdx_fn.normalise_spdx("raw").alias("norm"), spdx_fn.valid_spdx("raw").alias("valid"),
        spdx_fn.canonical_spdx("raw").alias("canonical"), ref.alias("r"))
    return out.select("p_partkey", "raw", "norm", "valid", "canonical", F.col("r.spdx").alias("spdx"),
                      F.col("r.expression").alias("expression"), F.col("r.resolved").alias("resolved"),
                      F.col("r.confidence").alias("confidence"))


@query
def licence_resolve(spark, sf):
    p = rs.resolve(b.part_dependencies(spark, sf), corpus())
    return p.select("p_partkey", "raw", "spdx", "entry_spdx", "entry_family", "entry_permissiveness",
                    ids.licence_label("spdx", "raw").alias("licence"))


@query
def unresolved_licences(spark, sf):
    u = rs.unresolved(rs.resolve(b.dependencies(spark, sf), corpus()))
    return u.select("project_id", "id", "reason")


@query
def notice_order(spark, sf):
    """What a run wants said, numbered in the order in which a report lists it."""
    said = ev.notices(rule_outcomes(spark, sf)).select("project_id", "code", "message")
    return graph.in_order(said, graph.NOTICE_ORDER).select("project_id", "position", "code", "message")


@query
def undetermined_order(spark, sf):
    """Items that could not be decided, in the order of a report."""
    u = ev.undetermined(rule_outcomes(spark, sf)).select("project_id", "kind", "id")
    return graph.in_order(u, graph.UNDETERMINED_ORDER).select("project_id", "position", "kind", "id")


def _finding_columns(outcomes):
    found = ev.findings(vd.with_effective_severity(outcomes))
    return found.select(*FINDING, "finding_id", "licence")


@query
def obligation_findings(spark, sf):
    o = rule_outcomes(spark, sf)
    return _finding_columns(o.filter(F.col("source") == "obligation"))


@query
def unknown_obligations(spark, sf):
    u = ev.undetermined(rule_outcomes(spark, sf).filter(F.col("rule_id").isNotNull()))
    return u.select("project_id", "id", "kind", "reason", "undetermined_field", "error_code")


@query
def trap_findings(spark, sf):
    o = rule_outcomes(spark, sf)
    return _finding_columns(o.filter(F.col("source") == "trap"))


@query
def own_trap_findings(spark, sf):
    """Licence entries with traps of their own; an UNKNOWN trap stays silent."""
    docs = {k: list(v) for k, v in corpus().documents.items()}
    own = [
        {"id": "own.mit.large", "severity": "CONDITION", "confidence": "HIGH", "title": "large user", "summary": "large user",
         "when": {"op": ">=", "field": "scale.employees", "value": 1000}, "citation": {"url": "u", "section": "s"}},
        {"id": "own.mit.not-europe", "severity": "NOTE", "confidence": "LOW", "title": "outside", "summary": "outside",
         "when": {"op": "not", "x": {"op": "in", "field": "territories", "value": ["EU", "GB"]}}, "citation": {"url": "u", "section": "s"}},
    ]
    docs["licences"] = [dict(e, traps=own) if e["spdx_id"] == "MIT" else e for e in docs["licences"]]
    o = ev.evaluate(rows(spark, sf), loader.build(docs), b.TODAY)
    return _finding_columns(o.filter(F.col("source") == "own_trap"))


PREDICATES = {
    "commercial": {"op": "==", "field": "use.commercial", "value": True},
    "not_saas": {"op": "!=", "field": "use.saas", "value": True},
    "model_in": {"op": "in", "field": "use.licence_model", "value": ["dual", "open-source"]},
    "big": {"op": ">", "field": "scale.mau", "value": 700000000},
    "small_team": {"op": "<=", "field": "scale.employees", "value": 250},
    "rich": {"op": ">=", "field": "scale.revenue_eur", "value": 200000},
    "name_has_7": {"op": "contains", "field": "project.name", "value": "7"},
    "either": {"op": "or", "l": {"op": "<", "field": "scale.mau", "value": 500000000},
               "r": {"op": "<", "field": "scale.employees", "value": 100}},
    "both": {"op": "and", "l": {"op": "!=", "field": "scale.employees", "value": 7},
             "r": {"op": "==", "field": "scale.revenue_eur", "value": 5}},
    "negated": {"op": "not", "x": {"op": "and", "l": {"op": "==", "field": "use.modified", "value": True},
                                   "r": {"op": ">", "field": "scale.mau", "value": 100000000}}},
}
TERRITORY = {
    "eq_us": {"op": "==", "field": "territories", "value": "us"},
    "ne_us": {"op": "!=", "field": "territories", "value": "US"},
    "in_eu_gb": {"op": "in", "field": "territories", "value": ["EU", "gb"]},
    "in_us_cn": {"op": "in", "field": "territories", "value": ["US", "CN"]},
    "has_cn": {"op": "contains", "field": "territories", "value": "CN"},
    "has_eu": {"op": "contains", "field": "territories", "value": "eu"},
}


def _truths(intents, trees):
    cells = []
    for name, tree in trees.items():
        c = predicates.compile_predicate(tree, ev.row_field)
        cells.append(F.struct(
            F.lit(name).alias("predicate"),
            F.when(c.truth, "TRUE").when(~c.truth, "FALSE").otherwise("UNKNOWN").alias("truth"),
            c.field.alias("field")))
    return intents.select("project_id", F.inline(F.array(*cells)))


@query
def scalar_predicates(spark, sf):
    return _truths(b.intents(spark, sf), PREDICATES)


@query
def territory_predicates(spark, sf):
    return _truths(b.intents(spark, sf), TERRITORY)


WHAT_IF = {
    "internal": {"use_commercial": False, "use_licence_model": "internal-only", "use_modified": True,
                 "use_network_exposed": False, "use_distributed": False, "use_saas": False, "scale_mau": 10},
    "hosted": {"use_commercial": True, "use_licence_model": "closed-source", "use_modified": True,
               "use_network_exposed": True, "use_distributed": False, "use_saas": True},
    "shipped": {"use_commercial": True, "use_licence_model": "closed-source", "use_modified": False,
                "use_network_exposed": False, "use_distributed": True, "use_saas": False, "scale_mau": 5},
}


@query
def what_if_intents(spark, sf):
    """Three declared uses per project in one evaluation: a join, not three scans."""
    deps = b.dependencies(spark, sf)
    projects = b.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"))
    intents = b.literal_intents(projects, WHAT_IF)
    outcomes = ev.evaluate(ev.evaluation_rows(ev.collapse(deps, corpus()), intents, corpus()), corpus(), b.TODAY)
    return vd.fold(outcomes, intents)


@query
def confidence_gate(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.element_at(F.array(*[F.lit(s) for s in fixed.SEVERITY_WEIGHT]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(*[F.lit(s) for s in fixed.CONFIDENCE_WEIGHT]), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("confidence"))
    return li.groupBy("severity", "confidence").agg(F.count(F.lit(1)).alias("n")).select(
        "severity", "confidence", sev.effective_severity("severity", "confidence").alias("strict"),
        sev.effective_severity("severity", "confidence", True).alias("lenient"),
        sev.downgrade_confidence("confidence").alias("lowered"),
        sev.severity_weight("severity").alias("weight"), "n")


@query
def staleness_downgrade(spark, sf):
    d = b.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("retrieved_at"),
                                              (F.col("l_suppkey") % 400).cast("int").alias("window_days"))
    d = d.withColumn("retrieved_at", F.when(F.col("window_days") == 7, F.lit("last spring")).when(
        F.col("window_days") == 8, F.lit("")).otherwise(F.col("retrieved_at")))
    today = "2000-06-30"
    return d.select(
        "retrieved_at", "window_days", sev.citation_stale("retrieved_at", today).alias("citation_stale"),
        sev.platform_stale("retrieved_at", "window_days", today).alias("platform_stale"),
    ).groupBy("retrieved_at", "citation_stale").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("platform_stale").alias("platform_stale_n"))


@query
def weights_divergence(spark, sf):
    resolved = rs.resolve(b.dependencies(spark, sf), corpus())
    d = crosscheck.weights_divergence(resolved, b.intents(spark, sf), corpus())
    return d.select("project_id", "dependency_id", "severity", "confidence", "title")


@query
def declared_vs_actual(spark, sf):
    resolved = rs.resolve(b.dependencies(spark, sf), corpus())
    d = crosscheck.declared_vs_actual(resolved, b.intents(spark, sf), corpus())
    return d.select("project_id", "dependency_id", "severity", "confidence", "message")


@query
def deny_list(spark, sf):
    """Projects by market segment never allow one licence each."""
    o = b.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"), "o_orderpriority")
    denied = o.select("project_id", F.when(F.col("o_orderpriority") == "1-URGENT", "AGPLv3").when(
        F.col("o_orderpriority") == "2-HIGH", "cc-by-nc-4.0").when(F.col("o_orderpriority") == "5-LOW", "GPL-3").alias("licence")
    ).filter(F.col("licence").isNotNull())
    hit = orgpolicy.deny_list(b.dependencies(spark, sf), b.intents(spark, sf), denied)
    return hit.select("project_id", "dependency_id", "licence", "severity", "confidence")


@query
def allow_waivers(spark, sf):
    """Findings under licences a project allows, some only for a stated use, become
    notes and stay visible."""
    o = b.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"), "o_orderstatus")
    allowed = o.select("project_id", F.when(F.col("o_orderstatus") == "O", "mit").when(F.col("o_orderstatus") == "F", "GPLv3").otherwise("BSD").alias("licence"),
                       F.when(F.col("o_orderstatus") == "F", json.dumps({"op": ">", "field": "scale.employees", "value": 70})).alias("when"))
    w = vd.with_effective_severity(orgpolicy.waive(rule_outcomes(spark, sf), allowed, b.intents(spark, sf))).filter(F.col("waived"))
    return w.select("project_id", "dependency_id", "rule_id", "severity", "effective_severity")


@query
def block_on_gate(spark, sf):
    """Findings each project stops on: some block on conditions too, some on notes
    alone, and those without a list on BLOCK."""
    o = b.table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"), "o_orderstatus")
    both, notes = F.array(F.lit("BLOCK"), F.lit("CONDITION")), F.array(F.lit("NOTE"))
    lists = o.select("project_id", F.when(F.col("o_orderstatus") == "O", both).when(F.col("o_orderstatus") == "F", notes).alias("block_on"))
    gated = orgpolicy.gate_on(vd.with_effective_severity(rule_outcomes(spark, sf)), lists)
    return gated.groupBy("project_id").agg(F.count(F.lit(1)).alias("stops"))


def part_exceptions(spark, sf):
    """Accepted risks, written per package: live for some, expired for others."""
    p = b.part_dependencies(spark, sf).select("p_partkey", "id", "ecosystem", "raw")
    any_kind = p.filter(F.col("ecosystem").isin("npm", "go")).select(
        (F.col("p_partkey") * 2).cast("int").alias("ordinal"), F.col("id").alias("dependency"), F.lit(None).cast("string").alias("kind"),
        F.lit("accepted").alias("reason"), F.lit("legal").alias("owner"),
        F.when(F.col("p_partkey") % 2 == 0, "2026-12-31").otherwise("2026-01-31").alias("expires"))
    one_kind = p.filter(F.col("raw").isin("", "see LICENSE", "Foo OR Bar")).select(
        F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey") * 2 - 1).otherwise(F.col("p_partkey") * 2 + 1).cast("int").alias("ordinal"),
        F.col("id").alias("dependency"), F.lit("trap.licence.absent-all-rights-reserved").alias("kind"), F.lit("known").alias("reason"),
        F.lit("platform").alias("owner"), F.lit(b.TODAY).alias("expires"))
    return any_kind.unionByName(one_kind)


ESCALATIONS = [("family", "weak-copyleft", "BLOCK"), ("family", "permissive", "NOTE"), ("licence", "isc", "BLOCK"),
               ("licence", "MPL-2.0", "CONDITION"), ("licence", "no licence declared", "BLOCK")]


def with_policy(spark, sf):
    """Two organisations that contradict each other: what one still accepts has expired
    for the other, and they raise the same licences to different bands."""
    rows = [("a", *e) for e in ESCALATIONS] + [("b", "licence", "isc", "CONDITION")]
    esc = local_frame(spark, rows, "org string, " + orgpolicy.ESCALATION_SCHEMA)
    ex = part_exceptions(spark, sf)
    other = F.when(F.col("expires") == "2026-12-31", "2026-01-31").when(F.col("expires") == "2026-01-31", "2026-12-31").otherwise(F.col("expires"))
    both = ex.withColumn("org", F.lit("a")).unionByName(ex.withColumn("org", F.lit("b")).withColumn("expires", other))
    key = b.table(spark, sf, "orders").select("o_orderkey")
    orgs = key.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("org"))
    return orgpolicy.apply_policy(rule_outcomes(spark, sf), corpus(), both, esc, b.TODAY, orgs)


@query
def org_exceptions(spark, sf):
    a = with_policy(spark, sf).filter(F.col("policy_decision").isin("excepted", "expired"))
    return a.select("project_id", "dependency_id", "rule_id", "corpus_severity", "severity", "policy_decision",
                    "exception_owner", "exception_expires")


@query
def org_escalations(spark, sf):
    a = vd.with_effective_severity(with_policy(spark, sf).filter(F.col("policy_decision") == "raised"))
    return a.select("project_id", "dependency_id", "rule_id", "corpus_severity", "severity", "confidence", "effective_severity")


@query
def verdict_fold(spark, sf):
    deps, intents = inputs(spark, sf)
    return vd.fold(all_outcomes(deps, intents), intents)


@query
def verdict_counts(spark, sf):
    """Verdicts of the rules alone, from collapsed dependencies: no finding is built."""
    deps, intents = inputs(spark, sf)
    small = ev.collapse(deps, corpus())
    return vd.fold(ev.evaluate(ev.evaluation_rows(small, intents, corpus()), corpus(), b.TODAY), intents).drop("intent_id")


@query
def band_counts(spark, sf):
    """Findings per rule and effective band over the fleet."""
    o = vd.with_effective_severity(all_outcomes(*inputs(spark, sf))).filter(F.col("rule_id").isNotNull())
    return o.groupBy("rule_id", "effective_severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNotNull()).alias("undecided"))


@query
def kind_counts(spark, sf):
    return vd.dependency_counts(b.dependencies(spark, sf))


@query
def exit_gate(spark, sf):
    v = verdict_fold(spark, sf)
    return v.select("project_id", "verdict", vd.exit_code("verdict").alias("plain"), vd.exit_code("verdict", strict=True).alias("strict"),
                    vd.exit_code("verdict", fail_on="CONDITION").alias("fail_on_condition"),
                    vd.exit_code("verdict", True, "note").alias("strict_fail_on_note"))
