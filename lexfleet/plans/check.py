"""The whole check of a fleet of projects, from a file listing to verdicts.

What many later steps read - the listing, file texts, declarations, source events,
dependencies, outcomes - is materialised once in the shared checkpoint folder;
everything between those stages is one declared plan.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexfleet.functions import fixed, text as tx
from lexfleet.operators import crosscheck, evaluate as ev, graph, orgpolicy, ownership as own, platforms as pf, resolve as rs, verdict as vd
from lexfleet.session import materialise, fact_join
from lexfleet.sources import assets, files as fs, manifests as mf, signals as sg, weights as wt

DEPENDENCY_COLUMNS = [
    "project_id", "id", "kind", "name", "version", "ecosystem", "scope", "direct", "spdx", "raw", "licence_source", "expression", "resolved",
    "licence_confidence", "declared_licence", "evidence_path", "evidence_line", "signal", "metadata",
]
_OTHER_TYPES = {"metadata": "map<string,string>"}  # the rest are strings where a stage has none


@dataclass
class Scan:
    dependencies: DataFrame
    undetermined: DataFrame   # found while scanning: (project_id, id, kind, reason, error_code, …)
    warnings: DataFrame       # (project_id, code, path)
    own_licences: DataFrame
    evidence: DataFrame       # all places of a dependency: (project_id, id, path, line, excerpt)


@dataclass
class Check:
    outcomes: DataFrame
    verdicts: DataFrame
    notices: DataFrame        # (project_id, code, message)
    stops: DataFrame = None   # findings that a project blocks on, when its lists are given
    platform_evidence: DataFrame = None  # all places behind a platform's findings: (project_id, platform, evidence_path, evidence_line)


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _staged(df: DataFrame, stage: int) -> DataFrame:
    """Dependency columns plus the position that decides which write of an id is last."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast(_OTHER_TYPES.get(c, "string")).alias(c) for c in DEPENDENCY_COLUMNS]
    return df.select(*have).withColumn("stage_seq", F.struct(F.lit(stage).alias("stage"), "scope", "evidence_path", "evidence_line"))


def _named(files: DataFrame, names) -> DataFrame:
    return files.filter(tx.base_name("rel").isin(list(names)))


def _text_candidates(files: DataFrame) -> DataFrame:
    """Files some reader wants, which are then read in full."""
    base = F.lower(tx.base_name("rel"))
    manifest = tx.base_name("rel").isin([n for n, *_ in fixed.MANIFEST_NAMES])
    legal = tx.is_licence_file_name("base") | tx.brand_stem("base").isin(fixed.TRADEMARK_FILE_STEMS) | base.endswith(".md") | (base == "config.json")
    source = sg.classify().isNotNull()
    return files.withColumn("base", tx.base_name("rel")).filter(manifest | legal | source).drop("base")


def scan(files: DataFrame, ignores: DataFrame = None, texts: DataFrame = None, probed: DataFrame = None) -> Scan:
    """`files`: listing (project_id, rel, length, modification_time, path). `texts` and
    `probed` may be given when contents come from elsewhere than the file system."""
    kept = fs.within_limits(fs.prune(files))
    marked = materialise(fs.mark_ignores(kept, ignores) if ignores is not None else kept.withColumn("ignored_by", F.lit(None).cast("string")))
    listed = marked.filter("ignored_by is null").drop("ignored_by")
    texts = texts if texts is not None else materialise(fs.read_texts(_text_candidates(listed)))
    probed = probed if probed is not None else materialise(wt.probe(listed))

    units = materialise(fs.discover_units(listed))
    declared = materialise(mf.read_declared(texts.select("project_id", "rel", "text")))
    packages = materialise(graph.upsert(_staged(graph.to_dependencies(mf.chosen_declarations(units, declared)), 0)))

    legal = texts.filter(tx.is_licence_file_name(tx.base_name("rel"))).withColumn("norm", tx.normalise_text("text"))
    legal = materialise(legal.select("project_id", "rel", tx.recognise_licence("norm").alias("text_spdx")))
    in_tree = own.containing_scope(legal.filter(fs.inside_dependency_dir()), units)
    with_vendored = own.attach_vendored(in_tree, packages)

    found = wt.inventory(probed)
    weights = materialise(wt.weight_dependencies(found, wt.licence_sources(texts), units))
    events = materialise(sg.events(texts))
    found_signals = materialise(sg.signals(events))
    upstream = sg.upstream_dependencies(found_signals)
    brand = assets.asset_dependencies(assets.asset_signals(listed.select("project_id", "rel").join(texts.select("project_id", "rel", "text"), ["project_id", "rel"], "left")), units)
    everything = _union([_staged(with_vendored, 1), _staged(weights, 2), _staged(upstream, 3), _staged(brand, 4)])

    manifests = _union([mf.npm_own_licence(_named(texts, ["package.json"])), mf.go_own_licence(_named(texts, ["go.mod"])),
                        mf.toml_own_licence(_named(texts, ["pyproject.toml", "Cargo.toml"])).drop("malformed")])
    stated = manifests.filter(~F.col("rel").contains("/")).select("project_id", F.concat(F.lit("0"), "rel").alias("ordinal"), "own_licence")
    root = legal.filter(~F.col("rel").contains("/")).select("project_id", F.concat(F.lit("1"), "rel").alias("ordinal"), F.col("text_spdx").alias("own_licence"))

    place = lambda df: df.select("project_id", "code", "path")
    warnings = _union([
        place(fs.over_limit_warnings(listed)), place(fs.depth_warnings(listed)), place(fs.ignore_warnings(marked)), place(fs.unsupported_warnings(units)), place(mf.fallback_warnings(units, declared)),
        place(fs.stale_lockfiles(units, listed).withColumn("path", F.col("lockfile"))),
        place(mf.json_warnings(_named(texts, ["package.json"]), False)), place(mf.json_warnings(_named(texts, ["package-lock.json", "npm-shrinkwrap.json", "Pipfile.lock"]), True)),
        place(mf.requirement_warnings(_named(texts, ["requirements.txt", "requirements-dev.txt"]))), place(own.unrecognised_texts(in_tree)),
        place(wt.unparseable_configs(texts)), place(wt.truncated_headers(probed)), place(sg.oversized_warnings(listed)), place(sg.opaque_spawns(events)),
    ])
    # every write of a row is a place where the dependency was seen
    seen = everything.filter(F.coalesce("evidence_path", F.lit("")) != "").select("project_id", "id", F.col("evidence_path").alias("path"), F.col("evidence_line").alias("line"), F.lit("").alias("excerpt"))
    declared_at = packages.filter(F.coalesce("evidence_path", F.lit("")) != "").select("project_id", "id", F.col("evidence_path").alias("path"), F.col("evidence_line").alias("line"), F.lit("").alias("excerpt"))
    evidence = _union([seen, declared_at, sg.upstream_evidence(found_signals)]).groupBy("project_id", "id", "path", "line").agg(F.max("excerpt").alias("excerpt"))
    return Scan(materialise(graph.upsert(everything)), wt.licence_not_found(weights), warnings, mf.own_licence(_union([stated, root])), evidence)


def evaluate(scanned: Scan, intents: DataFrame, corpus, today: str, policy=None, denied: DataFrame = None, allow_medium_blockers=False,
             orgs: DataFrame = None, allow_if: DataFrame = None, block_on: DataFrame = None) -> Check:
    """Rules, cross checks, platform terms, policy, fold. `policy` is (exceptions, escalations),
    per organisation when `orgs` (project_id, org) is given; `allow_if` and `block_on` are
    the projects' own (see orgpolicy.waive and orgpolicy.gate_on)."""
    deps = scanned.dependencies
    spark = deps.sparkSession
    resolved = rs.resolve(deps, corpus)
    matched = materialise(pf.match_platforms(pf.signals_of(deps), corpus))
    layers = [
        ev.evaluate(ev.evaluation_rows(deps, intents, corpus), corpus, today),
        pf.platform_outcomes(matched, intents, corpus, today),
    ]
    if corpus.trap(crosscheck.DIVERGENCE):
        layers.append(crosscheck.weights_divergence(resolved, intents, corpus))
    if corpus.trap(crosscheck.CONFLICT):
        layers.append(crosscheck.declared_vs_actual(resolved, intents, corpus))
    if denied is not None:
        layers.append(orgpolicy.deny_list(deps, intents, denied))
    scan_items = fact_join(scanned.undetermined, intents.select("project_id", "intent_id"), "project_id", "inner")
    layers.append(scan_items.select("project_id", "intent_id", F.col("id").alias("dependency_id"), F.col("kind").alias("dep_kind"), "reason",
                                    "evidence_path", "evidence_line"))
    outcomes = materialise(_union(layers))
    notices = [ev.notices(outcomes).select("project_id", "code", "message"), pf.unmatched(matched).select("project_id", "code", "message"),
               pf.stale_notices(matched, corpus, today)]
    if policy is not None:
        outcomes = materialise(orgpolicy.apply_policy(outcomes, corpus, *policy, today, orgs))
        notices.append(orgpolicy.expired_notices(outcomes).select("project_id", "code", "message"))
    if allow_if is not None:
        outcomes = materialise(orgpolicy.waive(outcomes, allow_if, intents))
    stops = orgpolicy.gate_on(vd.with_effective_severity(outcomes), block_on) if block_on is not None else None
    return Check(outcomes, vd.fold(outcomes, intents, allow_medium_blockers), _union(notices), stops, pf.platform_evidence(matched))
