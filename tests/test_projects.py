"""The whole check over a fleet of small projects on disk."""

import collections

import pytest
from pyspark.sql import functions as F

import projects
from lexfleet.operators import evaluate as ev
from lexfleet.plans import bindings, check
from lexfleet.sinks import reports
from lexfleet.session import local_frame
from lexfleet.sources import files as fs


@pytest.fixture(scope="module")
def result(spark, corpus, tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    projects.write(root)
    files = fs.list_files(spark, str(root))
    facts = [c for c in bindings.INTENT_TYPES]
    rows = [(name, "declared", name, *[use.get(c, [] if c == "territories" else None) for c in facts]) for name, (_, use, *_rest) in projects.PROJECTS.items()]
    intents = local_frame(spark, rows, "project_id string, intent_id string, project_name string, " + ", ".join(f"{c} {t}" for c, t in bindings.INTENT_TYPES.items()))
    scanned = check.scan(files)
    done = check.evaluate(scanned, intents, corpus, "2026-09-23")
    outcomes = done.outcomes
    by = lambda df, cols: collections.defaultdict(list, {k: [tuple(r)[1:] for r in rs] for k, rs in _group(df.select("project_id", *cols).collect()).items()})
    return {
        "verdicts": {r.project_id: r.verdict for r in done.verdicts.collect()},
        "findings": by(reports.finding_rows(outcomes), ["dependency_id", "rule_id", "effective_severity"]),
        "undetermined": by(ev.undetermined(outcomes), ["id", "reason"]),
        "warnings": by(scanned.warnings, ["code"]), "notices": by(done.notices, ["code"]),
        "scanned": scanned, "done": done, "outcomes": outcomes,
    }


def _group(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.project_id].append(r)
    return out


@pytest.mark.parametrize("name", list(projects.PROJECTS))
def test_project(result, name):
    _, _, verdict, findings, undetermined, warnings, notices = projects.PROJECTS[name]
    assert sorted(result["findings"][name]) == sorted(findings)
    assert sorted(result["undetermined"][name]) == sorted(undetermined)
    assert sorted(c for (c,) in result["warnings"][name]) == sorted(warnings)
    assert sorted(c for (c,) in result["notices"][name]) == sorted(notices)
    assert result["verdicts"][name] == verdict


def test_no_blocker_below_high_confidence(result):
    f = reports.finding_rows(result["outcomes"])
    assert f.filter((F.col("effective_severity") == "BLOCK") & (F.col("confidence") != "HIGH")).count() == 0


def test_every_finding_is_cited(spark, corpus, result):
    from lexfleet.operators import corpus_ops as co

    f = ev.findings(result["outcomes"])
    cites = corpus.frame(spark, "citations")
    assert co.missing_citations(f, cites).count() == 0
    assert co.require_cited(f, cites).count() == f.count()
    with pytest.raises(Exception, match="uncited finding"):
        co.require_cited(f, cites.filter("section <> '§13'")).count()


def test_dependency_rows_are_sound(result):
    from lexfleet.operators import quality as dq

    assert dq.dependencies(result["scanned"].dependencies).count() == 0


def test_own_licence_is_read(spark):
    from lexfleet.sources import manifests as mf

    files = spark.createDataFrame([("a", "package.json", '{"license":"ISC"}'), ("b", "package.json", '{"licenses":[{"type":"MIT"}]}'),
                                   ("c", "package.json", '{"licence":"X","license":{"type":"no"}}')], "project_id string, rel string, text string")
    assert {r.project_id: r.own_licence for r in mf.npm_own_licence(files).collect()} == {"a": "ISC", "b": "MIT", "c": "X"}


def test_every_dependency_has_evidence(result):
    scanned = result["scanned"]
    assert scanned.dependencies.join(scanned.evidence, ["project_id", "id"], "left_anti").count() == 0
    assert scanned.evidence.count() == scanned.evidence.select("project_id", "id", "path", "line").distinct().count()
