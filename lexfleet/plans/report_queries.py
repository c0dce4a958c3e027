"""Identifier, corpus, report, suggestion, quality and stream queries."""

import uuid

from pyspark.sql import functions as F, types as T

from lexfleet.functions import ids, spdx as spdx_fn, text as tx
from lexfleet.operators import corpus_ops as co, evaluate as ev, graph, quality as dq, suggestions as sg, verdict as vd
from lexfleet.operators.ranking import ordinal_within
from lexfleet.plans import bindings as b, core
from lexfleet.plans.registry import query
from lexfleet.session import ensure_checkpoint_dir, pinned
from lexfleet.sinks import reports, sbom
from lexfleet.sources import signals as sig, weights as wt
from lexfleet.streaming import latest, verdicts as stream


# ---- identifiers -------------------------------------------------------------------

@query
def finding_ids(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    dep = F.concat(F.lit("npm:"), F.col("l_partkey").cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", ids.finding_id(dep, F.concat(F.lit("rule."), F.col("l_linenumber").cast("string"))).alias("finding_id"))


@query
def intent_hash(spark, sf):
    i = b.intents(spark, sf)
    return i.select("project_id", ids.intent_hash(never_allow=F.array(F.lit("GPL-3.0-only"), F.col("use_licence_model")),
                                                  block_on=F.array(F.lit("BLOCK"))).alias("intent_hash"))


@query
def document_uuid(spark, sf):
    return sbom.document_digest(b.dependencies(spark, sf))


@query
def dependency_ids(spark, sf):
    p = b.part_dependencies(spark, sf)
    return p.select("p_partkey", "id", ids.display_name("id").alias("display"), ids.local_id("vendored", F.concat(F.lit(r"third_party\ "), F.col("name"))).alias("local_id"))


@query
def purls(spark, sf):
    p = b.parts(spark, sf).withColumn("odd", F.concat(F.col("name"), F.lit(" #?[x]%")))
    return p.select("p_partkey", ids.purl("ecosystem", "name", "version").alias("purl"), ids.purl("ecosystem", "odd", F.lit("")).alias("odd_purl"))


# ---- text functions on documents and pages -----------------------------------------

@query
def text_cleanup(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.sha2(tx.markdown_escape("text"), 256).alias("escaped"), F.sha2(tx.collapse_space("text"), 256).alias("collapsed"),
                    F.length(tx.clip_text("text")).alias("clipped_chars"))


@query
def path_safety(spark, sf):
    d = b.table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", "/").alias("n"))
    shape = F.element_at(F.array(F.col("n"), F.concat(F.lit("/"), "n"), F.concat(F.lit("./"), "n"), F.concat(F.lit("../"), "n"), F.concat(F.lit("C:"), "n"),
                                 F.concat(F.lit("a\\"), "n"), F.concat(F.col("n"), F.lit("#x")), F.lit("  ")), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = d.select("p_partkey", shape.alias("path"))
    return p.select("p_partkey", "path", tx.safe_relative("path").alias("safe"), tx.relative_uri("path").alias("uri"),
                    F.size(tx.safe_paths(F.array("path", F.lit("ok")))).alias("kept"))


@query
def version_ranges(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("v"))
    raw = F.element_at(F.array(*[F.concat(F.lit(a), "v", F.lit(z)) for a, z in (("^", ".1"), ("~", ""), (">=", ", <9"), ("==", ".0"), ("", ".x"), (" = ", " "), ("", " || 3"), ("!=", ""))]),
                       (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", tx.is_range("raw").alias("is_range"), tx.clean_version("raw").alias("version"))


@query
def territory_codes(spark, sf):
    n = b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    code = F.element_at(F.array(F.substring("c_mktsegment", 1, 2), F.lit("global"), F.lit("EEA"), F.lower(F.substring("c_mktsegment", 1, 2)), F.col("c_mktsegment"), F.lit(" US "), F.lit("")),
                        (F.col("c_custkey") % 7 + 1).cast("int"))
    return n.select("c_custkey", code.alias("code")).select("c_custkey", "code", tx.valid_territory("code").alias("valid"))


@query
def licence_file_names(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", "-").alias("n"))
    base = F.element_at(F.array(F.lit("LICENSE"), F.concat(F.lit("Licence-"), "n"), F.concat("n", F.lit(".md")), F.lit("license."), F.concat(F.lit("COPYING."), "n"), F.lit("NOTICE"),
                                F.concat(F.lit("my-license-"), "n"), F.lit("copying-x")), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", base.alias("base")).select("p_partkey", "base", tx.is_licence_file_name("base").alias("is_licence"), tx.brand_stem("base").alias("stem"))


@query
def front_matter(spark, sf):
    """Licence keys in the leading block of every document, resolved."""
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    head = F.element_at(F.array(F.lit("---\r\ntitle: x\r\nLicense: mit\r\n---\r\n"), F.lit("---\nlicense_name: Apache 2.0\nlicence: MIT\n---\n"), F.lit("---\ntags: []\n---\nlicense: MIT\n"),
                                F.lit("license: MIT\n---\n"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    raw = d.select("doc_id", tx.front_matter_licence_raw(F.concat(head, "text")).alias("raws"))
    return raw.select("doc_id", F.array_join("raws", "|").alias("raws"), F.coalesce(spdx_fn.normalise_spdx(F.try_element_at("raws", F.lit(1))), F.lit("")).alias("first"))


@query
def config_json(spark, sf):
    p = b.parts(spark, sf).select("p_partkey", "licence_raw")
    body = F.concat(F.element_at(F.array(F.lit('{"license":"'), F.lit('{"licence":"'), F.lit('{"license":" ","licence":"'), F.lit('{"x":"'), F.lit('not json "')),
                                 (F.col("p_partkey") % 5 + 1).cast("int")), "licence_raw", F.lit('"}'))
    return p.select("p_partkey", body.alias("text")).select("p_partkey", F.coalesce(tx.config_json_licence_raw("text"), F.lit("")).alias("raw"))


@query
def hosts_in_text(spark, sf):
    """Hosts of all addresses in a page: those of its text, its own (under another name,
    as the given one is ignored) and a second one behind the text."""
    p = b.table(spark, sf, "pages")
    own = F.regexp_replace("url", "example", "sample")
    text = F.concat(F.lit("see "), own, F.lit(" or http://Docs."), F.regexp_extract(own, "//([^/]+)", 1), F.lit("/x, not https://localhost.test/ "), "html", F.lit(" https://end.p"), F.col("page_id").cast("string"), F.lit(".io"))
    return p.select("page_id", F.array_join(sig.url_hosts_in_text(text), ",").alias("hosts"))


@query
def env_keys(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("n"))
    line = F.element_at(F.array(F.concat(F.lit("export "), "n", F.lit("=1")), F.concat(F.lit("# "), "n", F.lit("=1")), F.concat(F.lit("A-"), "n", F.lit("=1")), F.concat("n", F.lit(" = x=y")), F.lit("=z")),
                        (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", sig.env_key(line).alias("key"))


# ---- detection ------------------------------------------------------------------------

def _source_files(spark, sf):
    """A Go, Python, JavaScript, shell, Docker, workflow and sample-env file per part."""
    p = b.spread(b.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("project_id"), F.regexp_replace("p_name", " ", "-").alias("n"),
                                                   F.col("p_partkey").cast("string").alias("k")), "project_id")
    t = lambda *x: F.concat(*[F.col(v[1:]) if v.startswith("$") else F.lit(v) for v in x])
    rows = [
        ("cmd/main.go", t("package main\n// exec.Command(\"no\")\nfunc f() {\n\texec.Command(\"", "$n", "\", \"-v\")\n\texec.CommandContext(ctx, `tool", "$k", "`)\n\texec.Command(name)\n\texec.Command(\"git\")\n}\n")),
        ("a/run.py", t("import subprocess, os\n# os.system('no')\nsubprocess.run(['py", "$k", "', '-x'])\nos.system('/usr/bin/sys", "$k", " --a')\nsubprocess.run(cmd)\nrequests.get('https://api.svc", "$k", ".io/v1')\n")),
        ("web/x.ts", t("import cp from 'node:child_process';\n/* spawn('no')\n*/ spawn('js", "$k", "');\nfetch('https://Api.Svc", "$k", ".io/a'); fetch('https://example.com/')\n")),
        ("s.sh", t("#!/bin/sh\nfn() { echo; }\nA=1 sh", "$k", " --x | jq . && other", "$k", " \\\n  --more\nfn\nnpx tool-", "$k", " run\ncurl -s https://dl.svc", "$k", ".io/f\n")),
        ("Dockerfile", t("FROM --platform=x base\nFROM img", "$k", ":1.2 AS b\nRUN apt", "$k", " install && rm x\nENTRYPOINT [\"/bin/ent", "$k", "\"]\n")),
        (".github/workflows/ci.yml", t("jobs:\n  a:\n    steps:\n      - name: x\n        run: |\n          ci", "$k", " go\n          ls\n      - run: two", "$k", " now\n")),
        (".env.example", t("# no\nexport KEY_", "$k", "=1\nbad-key=2\n")),
        ("vendor/z.go", t("exec.Command(\"never\")")),
    ]
    cells = F.array(*[F.struct(F.lit(r).alias("rel"), c.alias("text")) for r, c in rows])
    return p.select("project_id", F.inline(cells)).withColumn("length", F.length("text").cast("long"))


@query
def source_signals(spark, sf):
    s = sig.signals(sig.events(_source_files(spark, sf)))
    return s.select("project_id", "rel", "line", "signal", "token", "confidence")


@query
def opaque_spawns(spark, sf):
    return sig.opaque_spawns(sig.events(_source_files(spark, sf))).select("project_id", "code", "path", "line")


@query
def finding_evidence(spark, sf):
    """All places at which an upstream row was seen."""
    e = sig.upstream_evidence(sig.signals(sig.events(_source_files(spark, sf))))
    return e.select("project_id", "id", "path", "line")


@query
def upstream_rows(spark, sf):
    u = sig.upstream_dependencies(sig.signals(sig.events(_source_files(spark, sf))))
    return u.select("project_id", "id", "name", "signal", "licence_confidence", "evidence_path", "evidence_line")


@query
def source_precedence(spark, sf):
    """Best licence source near each weight file of a supplier's directories."""
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    project = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("project_id")
    folder = F.concat(F.lit("m"), (F.col("l_orderkey") % 50).cast("string"))
    weights = li.filter("l_linenumber <= 3").select(project, F.concat(folder, F.lit("/w"), F.col("l_partkey").cast("string"), F.lit(".gguf")).alias("rel")).distinct()
    rank = (F.col("l_partkey") % 6).cast("int")
    near = F.when(F.col("l_linenumber") == 7, F.lit(".")).otherwise(folder)
    sources = li.filter("l_linenumber > 3").select(
        project, near.alias("dir"), rank.alias("rank"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("base")).distinct().select(
        "project_id", "dir", F.when(F.col("dir") == ".", F.col("base")).otherwise(F.concat("dir", F.lit("/"), "base")).alias("rel"), "rank",
        F.lit(0).alias("name_rank"), F.concat(F.lit("L-"), "base").alias("spdx"), F.lit("raw").alias("raw"), F.lit("x").alias("source"), F.lit("high").alias("confidence"))
    best = wt.pick_source(weights, sources)
    return weights.join(best, ["project_id", "rel"], "left").select("project_id", "rel", F.col("best.rank").alias("rank"), F.col("best.spdx").alias("spdx"))


@query
def upsert_last_wins(spark, sf):
    li = graph.upsert(b.line_items(spark, sf), keys=("l_orderkey", "l_partkey"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query
def provenance_min(spark, sf):
    li = b.table(spark, sf, "lineitem")
    cls = F.element_at(F.array(*[F.lit(x) for x in ("real", "derived", "estimated", "simulated", "unknown", "odd")]),
                       (F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber") % 6).otherwise(F.col("l_linenumber") % 3) + 1).cast("int"))
    return graph.weakest_provenance(li.select("l_orderkey", "l_suppkey", cls.alias("provenance")), ["l_orderkey"])


# ---- corpora ------------------------------------------------------------------------------

def _citations(spark, sf):
    """Parts citing clauses: the same clause with differing excerpts is a conflict."""
    p = b.table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").cast("int").alias("load_order"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("owner"),
        F.concat(F.lit("https://x.test/"), F.col("p_brand")).alias("url"), F.concat(F.lit("s"), (F.col("p_size") % 7).cast("string")).alias("section"),
        F.when(F.col("p_size") % 7 != 0, F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))).alias("excerpt"),
        F.when(F.col("p_size") % 7 != 0, F.lit("verbatim")).alias("excerpt_kind"), "p_type", "p_size")


@query
def citation_conflicts(spark, sf):
    return co.citation_index(_citations(spark, sf)).select("url", "section", "owner", "excerpt", "conflict", "uses")


@query
def citation_missing(spark, sf):
    """Findings whose clause a reduced corpus no longer carries."""
    known = core.corpus().frame(spark, "citations").filter(~F.col("section").isin("§4", "Permission notice"))
    f = ev.findings(core.rule_outcomes(spark, sf))
    return co.missing_citations(f, known).select("project_id", "finding_id", "citation_url", "citation_section")


@query
def entry_stats(spark, sf):
    c = _citations(spark, sf).select(F.col("p_type").alias("family"), F.col("owner").alias("spdx"), F.col("p_size").alias("obligations"), "url", "section")
    return co.entry_stats(c)


@query
def licence_lookup(spark, sf):
    p = b.parts(spark, sf).select("p_partkey", F.col("licence_raw").alias("licence"))
    return co.licence_lookup(p, core.corpus()).select("p_partkey", "licence", "spdx_id", "family", "obligations")


@query
def confidence_rises(spark, sf):
    """Two versions of every labelled document's entry."""
    l = b.table(spark, sf, "labels").select(F.concat(F.lit("LicenseRef-"), F.col("doc_id").cast("string")).alias("spdx"), "quality", "toxic", "doc_id")
    old = l.select("spdx", F.when(F.col("toxic") == 1, "LOW").otherwise("MEDIUM").alias("confidence"))
    new = l.select(F.lower("spdx").alias("spdx"), F.when(F.col("quality") == 1, "HIGH").otherwise("MEDIUM").alias("confidence"),
                   F.when(F.col("doc_id") % 2 == 0, "MEDIUM").alias("correction_from"))
    return co.confidence_rises(new, old)


@query
def territory_report(spark, sf):
    return co.territory_report(b.intents(spark, sf), core.corpus())


@query
def recovery_actions(spark, sf):
    u = ev.undetermined(core.rule_outcomes(spark, sf))
    return co.with_recovery(u).select("project_id", "id", "error_code", "action")


# ---- reports -------------------------------------------------------------------------------

@query
def sbom_components(spark, sf):
    c = sbom.evaluated_components(core.rows(spark, sf), core.corpus(), b.TODAY)
    return c.select("project_id", "id", sbom.component_type().alias("type"), ids.purl("ecosystem", "name", "version").alias("purl"),
                    sbom.licence_choice().alias("licence"), sbom.declared_licence().alias("declared"), sbom.concluded_licence().alias("concluded"),
                    "component_severity", "undetermined", F.size("findings").alias("findings"))


@query
def spdx_packages(spark, sf):
    c = sbom.evaluated_components(core.rows(spark, sf), core.corpus(), b.TODAY)
    return sbom.spdx_packages(c).select("project_id", "ordinal", "id", "spdx_id")


def _line_counts(spark, sf, each=1):
    """(project_id, _n): line items of a project, no fewer than its dependencies, `each` times."""
    return b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count(F.lit(1)) * each).alias("_n")).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"), "_n")


@query
def cyclonedx_documents(spark, sf):
    docs = sbom.cyclonedx(sbom.evaluated_components(core.rows(spark, sf), core.corpus(), b.TODAY), sizes=_line_counts(spark, sf))
    opened = F.from_json("document", "bomFormat string, serialNumber string, components array<struct<`bom-ref`:string>>, dependencies array<struct<dependsOn:array<string>>>")
    d = docs.select("project_id", opened.alias("v")).select("project_id", "v.*")
    return d.select("project_id", F.col("bomFormat").alias("format"), F.col("serialNumber").alias("serial"), F.size("components").alias("components"),
                    F.size(F.get("dependencies", F.lit(0))["dependsOn"]).alias("direct"), _added(F.transform("components", lambda c: c["bom-ref"])).alias("refs"))


@query
def sarif_results(spark, sf):
    r = reports.sarif_results(core.rule_outcomes(spark, sf))
    return r.select("project_id", "item_id", "rule_id", "level", "uri", "start_line")


@query
def sarif_rules(spark, sf):
    r = reports.sarif_rules(reports.sarif_results(core.rule_outcomes(spark, sf)))
    return r.select("project_id", "rule_id", "rule_index", "level")


def _added(texts):
    """A number that adds up over the texts of an array, in any order."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda a, x: a + F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


@query
def sarif_documents(spark, sf):
    """SARIF logs in small pages, opened again: results, their rules by index, a sum over all."""
    docs = reports.sarif_documents(core.rule_outcomes(spark, sf, shared=True), page_size=7)
    result = "struct<ruleId:string,ruleIndex:int,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>"
    log = F.from_json("document", f"version string, runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<{result}>>>")
    d = docs.select("project_id", log.alias("log")).select("project_id", "log.version", F.get("log.runs", F.lit(0)).alias("run"))
    place = lambda r: F.get(r["locations"], F.lit(0))["physicalLocation"]
    said = F.transform("run.results", lambda r: F.concat_ws("|", r["ruleId"], r["level"], place(r)["artifactLocation"]["uri"], place(r)["region"]["startLine"]))
    right = F.size(F.filter("run.results", lambda r: F.get(F.col("run.tool.driver.rules"), r["ruleIndex"])["id"] == r["ruleId"]))
    return d.groupBy("project_id", "version").agg(
        F.sum(F.size("run.results")).alias("results"), F.sum(right).alias("indexed"), F.max(F.size("run.tool.driver.rules")).alias("rules"), F.sum(_added(said)).alias("said"))


@query
def spdx_documents(spark, sf):
    """SPDX documents in small pages, opened again: packages, what the root contains, ids."""
    deps, intents = core.inputs(spark, sf)
    deps = pinned(deps.repartition("project_id"))  # crosses one shuffle by project, whatever reads it
    outcomes = core.all_outcomes(deps, intents)
    packages = sbom.spdx_packages(sbom.components(deps, outcomes, intents), _line_counts(spark, sf))
    docs = sbom.spdx(packages, vd.fold(outcomes, intents), sbom.document_digest(deps), page_size=3)
    body = F.from_json("document", "spdxVersion string, packages array<struct<SPDXID:string,name:string,comment:string>>, relationships array<struct<relationshipType:string,relatedSpdxElement:string>>")
    d = docs.select("project_id", body.alias("d")).select("project_id", "d.*")
    own = F.filter("packages", lambda p: p["SPDXID"] != "SPDXRef-RootPackage")
    linked = F.filter("relationships", lambda r: r["relationshipType"] == "CONTAINS")
    root = F.get(F.filter("packages", lambda p: p["SPDXID"] == "SPDXRef-RootPackage"), F.lit(0))["comment"]
    return d.groupBy("project_id", F.col("spdxVersion").alias("version"), root.alias("comment")).agg(
        F.sum(F.size(own)).alias("packages"), F.sum(F.size(linked)).alias("contains"), F.sum(_added(F.transform(own, lambda p: F.concat_ws("|", p["SPDXID"], p["name"])))).alias("ids"),
        (F.sum(_added(F.transform(own, lambda p: p["SPDXID"]))) == F.sum(_added(F.transform(linked, lambda r: r["relatedSpdxElement"])))).alias("same"))


@query
def markdown_lines(spark, sf):
    """How many items each project's Markdown report lists, per section."""
    outcomes = core.rule_outcomes(spark, sf, shared=True)
    v = vd.fold(outcomes, b.intents(spark, sf)).join(vd.dependency_counts(b.dependencies(spark, sf)), "project_id", "left").fillna(0)
    return reports.markdown_report(v, outcomes).groupBy("project_id", "section").agg(
        F.count_if(F.col("line").startswith("- ")).alias("items"), F.count_if(F.col("line").startswith("  - Gate:")).alias("gated"))


@query
def verdict_json(spark, sf):
    """Verdict documents, opened again: counts, and a sum over the hashes of all items."""
    outcomes = core.rule_outcomes(spark, sf, shared=True)
    docs = reports.verdict_json(vd.fold(outcomes, b.intents(spark, sf)), outcomes, page_size=12, rules=core.corpus().frame(spark, "rules"))
    d = reports.read_verdicts(docs)
    lists = ("blockers", "conditions", "notes")
    said = F.concat(*[F.transform(k, _finding_text(k)) for k in lists], F.transform("undetermined", lambda u: F.concat_ws("|", F.lit("?"), u["id"], u["kind"], u["reason"])))
    number = F.aggregate(said, F.lit(0).cast("long"), lambda a, x: a + F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    cells = d.select(F.col("project").alias("project_id"), "verdict", *[F.size(k).alias(k) for k in (*lists, "undetermined")], number.alias("items"))
    return cells.groupBy("project_id", "verdict").agg(*[F.sum(c).alias(c) for c in (*lists, "undetermined", "items")])


@query
def finding_order(spark, sf):
    """Position of every finding and undetermined item in its project's documents."""
    items = reports.document_items(core.rule_outcomes(spark, sf))
    narrow = items.select("project_id", *reports.ORDER, F.coalesce("finding.dependency_id", "item.id").alias("subject"), F.coalesce("finding.kind", "item.reason").alias("what"))
    most = 2 * core.corpus().frame(spark, "rules").count() + 1  # a rule gives a finding, an item or both
    placed = ordinal_within(narrow, ["project_id"], reports.ORDER, "position", sizes=_line_counts(spark, sf, most))
    return placed.select("project_id", F.col("position").cast("long").alias("position"), "subject", "what")


def _finding_text(section):
    return lambda f: F.concat_ws("|", F.lit(section), f["dependency_id"], f["kind"], f["severity"], f["confidence"], F.when(f["kind"].startswith("trap."), f["trap_id"]).otherwise(""))


@query
def report_lines(spark, sf):
    """How many lines each project's plain report has, per section."""
    outcomes = core.rule_outcomes(spark, sf, shared=True)
    v = vd.fold(outcomes, b.intents(spark, sf)).join(vd.dependency_counts(b.dependencies(spark, sf)), "project_id", "left").fillna(0)
    lines = reports.text_report(v, outcomes)
    return lines.groupBy("project_id", "section").agg(
        F.count_if(F.col("line").startswith("[")).alias("findings"), F.count_if(F.col("line").contains("gate:")).alias("gated"))


@query
def payload_rows(spark, sf):
    outcomes = core.rule_outcomes(spark, sf)
    f = reports.finding_rows(outcomes)
    p = sg.payload_rows(f, ev.undetermined(outcomes), "explain")
    v = F.col("v")  # read once, not once a field
    return p.select("project_id", "item_id", F.parse_json("payload").alias("v")).select("project_id", "item_id", F.variant_get(v, "$.project", "string").alias("project"), F.variant_get(v, "$.kind", "string").alias("kind"),
                    F.variant_get(v, "$.evidence_paths[0]", "string").alias("path"))


# ---- suggestions ------------------------------------------------------------------------------

def _answers(spark, sf):
    """All turns wrapped as model answers about the documents of the same number."""
    c = b.table(spark, sf, "conversations")
    item = F.concat(F.lit("doc:"), F.col("conv_id").cast("string"))
    answer = F.to_json(F.struct(
        F.when(F.col("turn") % 5 == 4, "triage").alias("job"),
        F.array(F.struct(item.alias("id"), F.col("text").alias("explanation")), F.struct(F.lit(" ").alias("id"), F.lit("x").alias("explanation"))).alias("findings"),
        F.array(F.struct(item.alias("finding_id"), F.lit("replace").alias("action"), F.when(F.col("turn") % 2 == 1, " High ").otherwise("huge").alias("effort"),
                         F.when(F.col("conv_id") % 3 == 0, "use other (Apache 2.0)").when(F.col("conv_id") % 3 == 1, "").otherwise("unknown thing").alias("alternative"))).alias("remediation"),
        F.array(F.struct(item.alias("finding_id"), F.lit("severity").alias("op"))).alias("overrides")))
    fenced = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(F.col("conv_id") % 17 == 5, F.col("text")).otherwise(answer)
    return c.select((F.col("conv_id") % 10).cast("string").alias("project_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("explain").alias("job"), fenced.alias("text"))


def _known_ids(spark, sf):
    """All documents as items with findings; those in other languages than English go by
    another kind of id, which no answer names."""
    d = b.table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "doc:").otherwise("text:")
    return d.select((F.col("doc_id") % 10).cast("string").alias("project_id"), F.concat(kind, F.col("doc_id").cast("string")).alias("item_id"))


@query
def suggestion_rejects(spark, sf):
    return sg.rejected_answers(_answers(spark, sf)).select("project_id", "seq", "message")


@query
def suggestion_admission(spark, sf):
    items, known = sg.parse_answers(_answers(spark, sf)), _known_ids(spark, sf)
    kept = sg.admit(items, known, known).select("project_id", "item_id", F.col("kind").alias("what"), F.lit("kept").alias("outcome"))
    gone = sg.refused(items, known, known).select("project_id", "item_id", F.col("message").alias("what"), F.col("code").alias("outcome"))
    return kept.unionByName(gone).groupBy("project_id", "item_id", "what", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def alternatives_verified(spark, sf):
    items = sg.parse_answers(_answers(spark, sf)).filter(F.col("kind") == "remediation")
    return sg.verify_alternatives(items, core.corpus()).select("project_id", "seq", "item_id", "effort", "alternative", "verified")


@query
def suggestion_merge(spark, sf):
    m = sg.merge(sg.parse_answers(_answers(spark, sf)).filter(F.col("kind") != "override"))
    return m.select("project_id", "kind", "item_id", "seq", F.length("body").alias("chars"))


# ---- quality ------------------------------------------------------------------------------------

@query
def dq_dependencies(spark, sf):
    li = b.table(spark, sf, "lineitem")
    path = F.element_at(F.array(F.lit("a/b"), F.lit("/abs"), F.lit("x/../y"), F.lit(""), F.lit("ok")), (F.col("l_suppkey") % 5 + 1).cast("int"))
    d = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("project_id"),
                  F.when(F.col("l_partkey") % 50 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("l_partkey") % 9).cast("string"))).alias("id"), path.alias("evidence_path"))
    return dq.dependencies(d).groupBy("project_id", "subject", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def dq_rules(spark, sf):
    """Rules made from parts, each broken in its own way."""
    p = b.table(spark, sf, "part")
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % n + 1).cast("int"))
    rules = p.select(
        F.concat(F.lit("r"), (k % 1500).cast("string")).alias("rule_id"), F.when(k % 2 == 0, "obligation").otherwise("trap").alias("source"),
        F.lit("K").alias("spdx_key"), pick(5, "BLOCK", "CONDITION", "NOTE", "INFO", "FATAL").alias("severity"), pick(4, "HIGH", "LOW", "MEDIUM", "maybe").alias("confidence"),
        pick(3, "ATTRIBUTION", "SCALE_GATE", "OTHER").alias("obligation_kind"), F.repeat(F.lit("m"), (k % 12).cast("int")).alias("message"), pick(6, "t", "t", "", "t", "t", "t").alias("title"),
        pick(7, None, "replace", "delete", None, None, None, None).alias("fix_action"), F.lit("HIGH").alias("fix_confidence"), pick(4, None, "graph", "dependency", "planet").alias("scope"),
        F.lit("https://x.test").alias("citation_url"), pick(9, "", *["s"] * 8).alias("citation_section"), pick(8, "e", None, "e", None, None, None, None, None).alias("citation_excerpt"),
        pick(8, "verbatim", "verbatim", "rumour", None, None, None, None, None).alias("citation_excerpt_kind"))
    return dq.rules(rules).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def dq_policy(spark, sf):
    """Exceptions and escalations made from parts, checked row by row."""
    p = b.table(spark, sf, "part")
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % n + 1).cast("int"))
    ex = p.select(k.cast("int").alias("ordinal"), pick(4, "d", "", "d", "d").alias("dependency"), pick(5, "r", None, "r", "r", "r").alias("reason"), pick(3, "o", "o", " ").alias("owner"),
                  pick(6, "2026-01-01", "", "soon", "2026-02-30", "2026-12-31", "2027-01-01").alias("expires"))
    es = p.select(pick(2, "family", "licence").alias("target_type"), pick(6, "permissive", "MIT", "alien", "", "custom", "ISC").alias("target"), pick(5, "BLOCK", "note", "CONDITION", "INFO", "block").alias("severity"))
    rows = dq.exceptions(ex).withColumn("what", F.lit("exception")).unionByName(dq.escalations(es).withColumn("what", F.lit("escalation")))
    return rows.groupBy("what", "problem").agg(F.count(F.lit(1)).alias("n"))


@query
def dq_intents(spark, sf):
    i = b.intents(spark, sf)
    broken = i.withColumn("use_saas", F.when(F.col("use_licence_model") != "dual", F.col("use_saas"))).withColumn(
        "use_licence_model", F.when(F.col("use_commercial"), F.lit("freeware")).otherwise(F.col("use_licence_model")))
    return dq.intents(broken)


@query
def intent_overlay(spark, sf):
    """Project facts over defaults of the market segment."""
    from lexfleet.sources import intents as si

    i = b.intents(spark, sf)
    user = i.select("project_id", *[F.lit(None).cast(i.schema[c].dataType).alias(c) for c in si.INTENT_FACTS if c not in ("scale_mau", "scale_employees", "use_saas")],
                    F.lit(5).cast("long").alias("scale_mau"), F.lit(7).cast("long").alias("scale_employees"), F.lit(True).alias("use_saas"))
    m = si.overlay(i, user)
    return m.select("project_id", "scale_mau", "scale_employees", "use_saas", F.array_join("overridden", ",").alias("overridden"))


def _json_text(*parts):
    """JSON text of literals and (after a $) columns."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@query
def policy_documents(spark, sf):
    """Organisation policies of every customer, some of them malformed, as rows."""
    from lexfleet.sources import intents as si

    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    full = _json_text('{"schema_version":1,"org":"x","escalate":{"families":{"weak-copyleft":"BLOCK"},"licences":{"MPL-', "$k", '":"CONDITION"}},"exceptions":[{"dependency":"npm:a@', "$k",
                      '","kind":"","reason":"r","owner":"o","expires":"2026-12-31"},{"dependency":"go:b@1","kind":"t.x","reason":"s","owner":"', "$c_mktsegment", '","expires":"2026-01-31"}]}')
    text = F.when(F.col("k") % 7 == 0, "{not json").when(F.col("k") % 7 == 1, '{"schema_version":1}').otherwise(full)
    exceptions, escalations = si.policy_rows(c.select(F.col("k").cast("string").alias("org"), text.alias("text")))
    rows = exceptions.select("org", F.lit("exception").alias("what"), F.col("ordinal").cast("string").alias("key"), F.concat_ws("|", "dependency", "kind", "reason", "owner", "expires").alias("value"))
    return rows.unionByName(escalations.select("org", F.col("target_type").alias("what"), F.col("target").alias("key"), F.col("severity").alias("value")))


@query
def intent_documents(spark, sf):
    """Declared uses of every order, read from JSON documents; what is left out is NULL."""
    from lexfleet.sources import intents as si

    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.col("o_custkey").alias("c"))
    shapes = [
        _json_text('{"schema_version":1,"project":{"name":" n', "$k", ' "},"use":{"commercial":true,"licence_model":"dual"},"scale":{"mau":', "$c", '},"territories":["EU","us"],"policy":{"never_allow":["GPL-3"],"block_on":["NOTE"],"ignore":[{"path":"a/**","reason":"r"}]}}'),
        _json_text('{"use":{"saas":false},"policy":{"allow_if":[{"licence":"MIT","when":""}]}}'), F.lit("[]"), F.lit("{broken"),
    ]
    text = F.element_at(F.array(*shapes), (F.col("k") % 4 + 1).cast("int"))
    d = si.read_documents(o.select(F.concat(F.lit("o"), F.col("k").cast("string")).alias("project_id"), F.concat(F.lit("d/cfg"), F.col("k").cast("string"), F.lit(".json")).alias("rel"), text.alias("text")))
    return d.select("project_id", "project_name", "use_commercial", "use_licence_model", "use_saas", "scale_mau", "scale_employees", F.array_join("territories", ",").alias("territories"),
                    F.array_join("policy.never_allow", ",").alias("never_allow"), F.array_join("policy.block_on", ",").alias("block_on"), F.size("policy.ignore").alias("ignores"))


# ---- streams ---------------------------------------------------------------------------------------

ARRIVALS = 4  # micro-batches at least that a streamed table comes in


def _place(spark, name):
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _arriving(spark, df, order):
    """A table as files that arrive one after the other, in the order of a column: the
    file source reads them by time, so each range is written when the one before is there,
    by all tasks that read the table."""
    path, kind = _place(spark, "arrivals"), df.schema[order].dataType
    cuts = df.agg(F.percentile_approx(order, [k / ARRIVALS for k in range(1, ARRIVALS)]).cast("array<string>")).first()[0] or []
    above = F.lit(0)
    for cut in cuts:
        above = above + F.coalesce(F.col(order) > F.lit(cut).cast(kind), F.lit(False)).cast("int")
    for k in range(len(cuts) + 1):
        df.filter(above == k).write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files // ARRIVALS)).parquet(path)


def _event_stream(spark, sf):
    raw = _arriving(spark, b.table(spark, sf, "events"), "ts")
    severity = F.when(F.col("event_type") == "error", "BLOCK").when(F.col("event_type") == "purchase", "CONDITION").otherwise("NOTE")
    confidence = F.when(F.col("value") > 60, "HIGH").when(F.col("value") > 10, "MEDIUM").otherwise("LOW")
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("project_id"), severity.alias("severity"), confidence.alias("confidence"),
                      F.when((F.col("event_type") == "signup") & (F.col("value") > 100), "licence_unresolved").alias("reason"),
                      F.concat_ws(":", "event_type", (F.col("event_id") % 200).cast("string")).alias("finding_id"))


def _drain(df, spark, name, keys=None):
    """Run a stream over what is there and read its sink back from the shared folder.
    With `keys` the stream updates rows: every epoch writes the rows that it changed
    into a folder of its own, and the last write of a key counts."""
    place = _place(spark, name)

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{place}/data/epoch={epoch}")

    writer = df.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", place + "/state").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])).parquet(place + "/data")
    if not keys:
        return rows.drop("epoch")
    others = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in others))


@query
def stream_verdict(spark, sf):
    """Verdict per day and project from a stream of findings, final state. State ends
    with the watermark."""
    return _drain(stream.windowed_verdicts(_event_stream(spark, sf), lateness="60 days"), spark, "stream_verdict", ["window_start", "project_id"])


POSITION = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _landed_versions(spark, sf, name):
    """Standing versions of dependencies (line items) that land by line number, so the
    versions of a dependency come in different micro-batches. One folder per epoch: a
    repeated epoch replaces itself."""
    place = _place(spark, name)
    parts, intents = b.part_dependencies(spark, sf), b.intents(spark, sf)
    raw = _arriving(spark, b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", *POSITION), "l_linenumber")
    rows = b.edges(raw, parts, POSITION)
    versions = latest.last_outcomes(ev.evaluation_rows(rows, intents, core.corpus()), core.corpus(), POSITION)

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{place}/data/epoch={epoch}")

    with latest.state_store(spark):
        versions.writeStream.outputMode("update").option("checkpointLocation", place + "/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(versions.schema).parquet(place + "/data")


@query
def stream_evaluate(spark, sf):
    """Dependency versions evaluated as they land; the last version of each counts, in
    whatever batch it came."""
    return latest.standing(_landed_versions(spark, sf, "stream_evaluate"), "rule_id", "reason")


@query
def stream_latest_verdicts(spark, sf):
    """Verdict of every project after the last epoch of the same stream."""
    standing = latest.standing(_landed_versions(spark, sf, "stream_latest"), "project_id", "intent_id", "rule_id", "reason")
    rules = ev.rule_dimension(spark, core.corpus(), b.TODAY).select("rule_id", "severity", "confidence")
    rows = standing.join(F.broadcast(rules), "rule_id", "left")
    unknown = F.col("reason").isNotNull()
    rows = rows.withColumn("severity", F.when(unknown, "NOTE").otherwise(F.col("severity"))).withColumn("confidence", F.when(unknown, "LOW").otherwise(F.col("confidence"))).withColumnRenamed("n", "weight")
    return vd.fold(rows, b.intents(spark, sf)).select("project_id", "verdict", "blockers", "conditions", "notes", "undetermined")


@query
def stream_dedupe(spark, sf):
    """Findings repeated in the stream are reported once."""
    d = _drain(stream.deduplicate(_event_stream(spark, sf), "60 days"), spark, "stream_dedupe")
    return d.groupBy("project_id").agg(F.count(F.lit(1)).alias("findings"))
