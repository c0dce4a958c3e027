"""Functions and readers on hand-written rows."""

import fnmatch
import hashlib
import io
import itertools
import zipfile
import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import projects
from lexfleet.functions import fixed, ids, severity as sev, text as tx
from lexfleet.operators import corpus_ops as co, digests as dg, graph, orgpolicy, quality as dq, suggestions as sg
from lexfleet.plans import check
from lexfleet.rules import loader
from lexfleet.sources import assets, files as fs, intents as si, manifests as mf, signals as sg_src, weights as wt


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn("x").alias("y")).collect()[0].y


def test_normalise_text(spark):
    assert one(spark, "﻿A ‘B’ \n\t“C” — D ", tx.normalise_text) == "a 'b' \"c\" - d"


def test_recognisers_need_all_phrases_and_order(spark):
    texts = {spdx: " x ".join(every) for spdx, every, _ in fixed.LICENCE_PHRASES}
    df = spark.createDataFrame(list(texts.items()), "want string, t string")
    for r in df.select("want", tx.recognise_licence("t").alias("got")).collect():
        assert r.got == r.want
    for spdx, every, none in fixed.LICENCE_PHRASES:
        if len(every) > 1:
            half = spark.createDataFrame([(every[0],)], "t string").select(tx.recognise_licence("t").alias("g")).collect()[0].g
            assert half != spdx


def test_prose_gate(spark):
    df = spark.createDataFrame([("noncommercial use",), ("licensed noncommercial",), ("the mit license and apache 2.0",), ("cc by-nc-sa licence",)], "t string")
    assert [r.g for r in df.select(tx.prose_licence("t").alias("g")).collect()] == [None, "CC-BY-NC-4.0", "Apache-2.0", "CC-BY-NC-SA-4.0"]


def test_dates(spark):
    rows = [("2026-03-27", False), ("2026-03-26", True), ("soon", True), ("", False), (None, False), ("2026-02-30", True)]
    df = spark.createDataFrame(rows, "d string, want boolean")
    for r in df.select("*", sev.citation_stale("d", "2026-09-23").alias("got")).collect():
        assert r.got == r.want, r
    assert not one(spark, "2020-01-01", lambda c: sev.citation_stale(c, "never"))
    assert one(spark, "2020-01-01", lambda c: sev.platform_stale(c, F.lit(30), "2026-09-23"))
    assert not one(spark, "bad", lambda c: sev.platform_stale(c, F.lit(30), "2026-09-23"))
    assert one(spark, "2026-09-23", lambda c: sev.exception_live(c, "2026-09-23"))


def test_names(spark):
    assert one(spark, "npm:@s/a@1.0", ids.display_name) == "@s/a"
    assert one(spark, "npm:@s/a", ids.display_name) == "@s/a"
    assert one(spark, "a|b`c\r\nd", tx.markdown_escape) == "a\\|b\\`c d"
    assert one(spark, "```json\n{\"a\":1}\n```", tx.strip_code_fence) == '{"a":1}'
    assert one(spark, "```", tx.strip_code_fence) == ""


def test_brand_evidence(spark):
    r = one(spark, "\n  Hello\nour Trade  Mark is reserved\n", lambda c: tx.brand_evidence(c))
    assert (r.line, r.excerpt) == (3, "our Trade  Mark is reserved")
    r = one(spark, "\n  Hello\n", lambda c: tx.brand_evidence(c))
    assert (r.line, r.excerpt) == (2, "Hello")


def test_host_suffixes(spark):
    assert one(spark, "a.b.example.com", tx.host_suffixes) == ["a.b.example.com", "b.example.com", "example.com", "com"]


def test_inside_root(spark):
    df = spark.createDataFrame([("app", "../lib", True), ("app", "../../out", False), (".", "./x/../../y", False), ("a/b", "../../c", True)], "d string, p string, want boolean")
    for r in df.select("*", graph.stays_inside("d", "p").alias("got")).collect():
        assert r.got == r.want, r


def test_weight_formats():
    def zipped(name):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, b"x")
        return out.getvalue()

    rows = [("a.safetensors", projects.SAFETENSORS, "SafeTensors"), ("a.gguf", projects.gguf(general__license="mit"), "GGUF"), ("a.h5", b"\x89HDF\r\n\x1a\n" + b"\0" * 8, "HDF5"),
            ("a.pkl", b"\x80\x04" + b"\0" * 14, "Pickle"), ("a.pt", zipped("archive/data.pkl"), "PyTorch (zip)"), ("a.zip", zipped("a.txt"), None), ("a.zip", b"PK\x03\x04" + b"\0" * 12, None),
            ("a.onnx", b"\x08\x07" + b"\0" * 14, "ONNX"), ("a.bin", b"\x08\x07" + b"\0" * 14, None), ("a.bin", b"GG", None), ("a.bin", b"", None),
            ("a.safetensors", b"\xff" * 8 + b"{" + b" " * 7, None), ("a.safetensors", b"\0" * 8 + b"{" + b" " * 7, None)]
    for rel, data, want in rows:
        got = wt.read_header(pa.PythonFile(io.BytesIO(data), mode="r"), len(data), rel)
        assert (got and got[0]) == want, rel
        assert wt.read_header(pa.PythonFile(io.BytesIO(data), mode="r"), len(data), rel, {"none"}) is None


def test_gguf_metadata():
    data = projects.gguf(general__license="mit", general__license__link="https://x.test")
    header = lambda data: wt._Header(pa.PythonFile(io.BytesIO(data), mode="r"), len(data))
    assert wt.gguf_metadata(header(data)) == ("mit", "https://x.test", False)
    assert wt.gguf_metadata(header(data[:60]))[2] is True
    # what was read before an early end counts, however far into the file it stands
    far = projects.gguf(general__long="x" * (3 << 20), general__license="mit", general__more="y" * 99)
    assert wt.gguf_metadata(header(far[:-20])) == ("mit", "", True)


def test_calls_and_fetches_are_read_in_full(spark):
    code = "requests.get(" + " " * 9_000 + "'https://far.io/x')\nx = 'https://not.io'\n" + "# " + "y" * (3 << 20) + "\nfetch('https://end.io')\n"
    sh = "curl https://one.io/x && wget -q https://two.io/y\n"
    rows = [("p", "a.py", len(code), code), ("p", "b.sh", len(sh), sh)]
    s = sg_src.signals(sg_src.events(spark.createDataFrame(rows, "project_id string, rel string, length long, text string"))).filter("signal = 'host'")
    assert sorted(r.token for r in s.collect()) == ["end.io", "far.io", "one.io", "two.io"]


def test_workflow_scripts():
    code = "jobs:\n  a:\n    run: no\n    steps:\n      - name: x\n        # c\n        run: |\n          one\n\n          two\n        env: y\n      - run: three\n      - run: >-\n          four\n"
    assert list(sg_src._workflow_scripts(code)) == [(7, "          one\n\n          two"), (0, "three"), (13, "          four\n")]


def test_everyday_tools(spark):
    names = ["python3.12", "python3.14", "cmd.exe", "cat.exe", "SHASUM", "sha384sum", "gawk", "ffmpeg"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.filter(sg_src.is_everyday_tool("n")).collect()] == ["python3.12", "cmd.exe", "SHASUM", "gawk"]


def test_no_file_is_dropped(spark):
    rows = [("p", "/".join("d" * 40) + "/LICENSE", 9 << 20), ("p", "a.py", 3 << 20), ("p", "LICENSE", 10)]
    kept = fs.within_limits(spark.createDataFrame(rows, "project_id string, rel string, length long"))
    assert sorted((r.over_limit, r.too_deep) for r in kept.collect()) == [(False, False), (False, False), (True, True)]
    assert check._text_candidates(kept).count() == 3


def test_comments_keep_line_numbers():
    src = 'a /* x\ny */ b // "c"\n"// no" \'#\' `/*`\n'
    assert sg_src.strip_comments(src, "go") == 'a \n b \n"// no" \'#\' `/*`\n'
    assert sg_src.strip_comments("'''# in\n''' x # out\n", "python") == "'''# in\n''' x \n"


def test_split_commands():
    assert [c.strip() for c in sg_src.split_commands("a 'x;y' && b | c; d $(e f)")][:4] == ["a 'x;y'", "b", "c", "d"]
    assert "e f)" in [c.strip() for c in sg_src.split_commands("d $(e f)")]
    assert [c.strip() for c in sg_src.split_commands('echo "$(tool x)"')][1].startswith("tool x")


def test_assets(spark):
    files = spark.createDataFrame([
        ("p", "vendor/a/logo.svg", None), ("p", "vendor/a/LICENSE", "You may not use the trademark."), ("p", "vendor/b/brand/x.png", None),
        ("p", "vendor/c/NOTICE", "All fine"), ("p", "logo.svg", None)], "project_id string, rel string, text string")
    units = spark.createDataFrame([("p", ".")], "project_id string, dir string")
    rows = {r.name: (r.signal, r.licence_confidence) for r in assets.asset_dependencies(assets.asset_signals(files), units).collect()}
    assert rows == {"vendor/a": ("licence_clause", "high"), "vendor/b": ("brand_directory", "medium")}


def test_prune_keeps_what_is_not_generated(spark):
    rels = ["src/a", ".git/x", "a/dist/b", "dist", "venv/pyvenv.cfg", "venv/lib/x", "env/readme", "node_modules/a/x", "node_modules/a/node_modules/b/x", "node_modules/.cache/x"]
    df = spark.createDataFrame([("p", r, 1, None) for r in rels], "project_id string, rel string, length long, modification_time timestamp")
    assert sorted(r.rel for r in fs.prune(df).collect()) == ["dist", "env/readme", "node_modules/a/x", "src/a"]


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "p" / "d").mkdir(parents=True)
    (tmp_path / "p" / "d" / "f.txt").write_text("hello")
    df = fs.list_files(spark, str(tmp_path))
    assert [(r.project_id, r.rel, r.length) for r in df.collect()] == [("p", "d/f.txt", 5)]
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert [r.text for r in fs.read_texts(df).collect()] == ["hello"]


def test_npm_v1_depth(spark):
    doc = {}
    for i in reversed(range(30)):
        doc = {f"n{i}": {"version": "1", **({"dependencies": doc} if doc else {})}}
    df = spark.createDataFrame([("p", "package-lock.json", json.dumps({"dependencies": doc}))], "project_id string, rel string, text string")
    rows = {r.name: r.direct for r in mf.npm_lock(df).collect()}
    assert len(rows) == 30 and rows["n0"] and not rows["n29"]


def test_malformed_inputs_warn(spark):
    df = spark.createDataFrame([("p", "package.json", "{"), ("p", "x/package.json", "[]")], "project_id string, rel string, text string")
    assert mf.npm_manifest(df).count() == 0 and mf.json_warnings(df, False).count() == 2
    bad = spark.createDataFrame([("p", "pyproject.toml", "= no")], "project_id string, rel string, text string")
    assert mf.pyproject(bad).count() == 0 and mf.toml_own_licence(bad).collect()[0].malformed


def test_intent_documents(spark):
    doc = {"schema_version": 1, "use": {"commercial": True, "licence_model": "dual", "modified": False, "network_exposed": False, "distributed": True, "saas": False},
           "scale": {"mau": 0}, "policy": {"ignore": [{"path": "x/**", "reason": "r"}], "never_allow": ["GPL-3.0-only"]}}
    df = spark.createDataFrame([("p", "intent.json", json.dumps(doc))], "project_id string, rel string, text string")
    d = si.read_documents(df)
    r = d.collect()[0]
    assert (r.project_name, r.use_commercial, r.scale_mau, r.scale_employees, r.territories) == ("intent", True, 0, None, [])
    assert si.ignore_rows(d).collect()[0].path == "x/**" and si.deny_rows(d).collect()[0].licence == "GPL-3.0-only"
    assert dq.intents(d).count() == 0


def test_policy_documents(spark):
    doc = {"org": "o", "escalate": {"families": {"custom": "BLOCK"}, "licences": {"MIT": "NOTE"}},
           "exceptions": [{"dependency": "d", "reason": "r", "owner": "o", "expires": "2026-01-01"}]}
    ex, es = si.policy_rows(spark.createDataFrame([("o", json.dumps(doc))], "org string, text string"))
    assert ex.count() == 1 and es.count() == 2
    assert dq.exceptions(ex).count() == 0
    assert [(r.subject, r.problem) for r in dq.escalations(es).collect()] == [("MIT", "may not lower")]
    a, b2 = orgpolicy.policy_tables(spark, doc)
    assert a.count() == 1 and b2.count() == 2


def test_shipped_corpus_is_sound(spark, corpus):
    f = lambda n: corpus.frame(spark, n)
    today = "2026-09-25"
    assert dq.licences(f("licences"), today).count() == 0
    assert dq.rules(f("rules")).count() == 0
    assert dq.platforms(f("platforms"), f("platform_tokens"), f("platform_clauses"), today).count() == 0
    assert dq.territory_gates(f("territory_gates")).count() == 0
    assert dq.citations(f("citations")).count() == 0
    assert dq.severity_bands(f("rules")).count() > 0  # a report, not an error
    stats = co.corpus_stats(co.corpus_tables(spark, corpus)).collect()
    assert {r.what: r["keys"] for r in stats if r.part is None and r.what} == {
        "licences": 12, "obligations": 39, "traps": 12, "platforms": 6, "territories": 4, "citations": co.citation_index(f("citations")).count()}
    assert [r.entries for r in stats if r.what is None] == [sum(r.entries for r in stats if r.part is not None)]
    assert co.token_claims(f("platform_tokens")).count() == 0
    keys = spark.createDataFrame([("https://opensource.org/license/mit#Permission notice",), ("x#y",)], "citation string")
    assert [r.owner for r in co.citation_lookup(keys, corpus).orderBy("citation").collect()] == ["mit.attribution", None]


def test_broken_corpora_are_refused(spark, corpus, tmp_path):
    entry = corpus.licences[0]
    with pytest.raises(loader.CorpusError, match="duplicate licence"):
        loader.build({"licences": [entry, dict(entry, spdx_id=entry["spdx_id"].lower())]})
    with pytest.raises(loader.CorpusError):
        loader.build({"traps": [{"id": "t", "severity": "BLOCK", "confidence": "HIGH", "when": {"op": "==", "field": "nope", "value": 1}}]})
    for n in loader.DOCUMENTS:
        (tmp_path / f"{n}.json").write_text("[]")
    (tmp_path / "manifest.json").write_text(json.dumps({"files": {f"{n}.json": "0" for n in loader.DOCUMENTS}}))
    with pytest.raises(loader.CorpusError, match="digest"):
        loader.load(tmp_path)


def test_quality_gate_fails_the_job(spark):
    rows = spark.range(3)
    clean = spark.createDataFrame([], "subject string, problem string")
    assert dq.require_clean(clean, rows).count() == 3
    with pytest.raises(dq.DataError, match="a: bad"):
        dq.require_clean(spark.createDataFrame([("a", "bad")], "subject string, problem string"), rows)


def test_checks_are_counted_while_writing(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else i % 5) for i in range(20)], "id long, x long")
    checks = {"small": F.col("x") < 4, "even": F.col("id") % 2 == 0}
    written, m = dq.watched(rows, F.col("id"), checks)
    assert written.count() == 20 and written.schema == rows.schema
    assert (m["rows"], m["check small"], m["check even"]) == (20, 5, 10)  # a NULL check fails
    assert m["bad"] == len({i for i in range(20) if i % 2 or i % 5 == 4 or i == 7})
    with pytest.raises(dq.DataError) as e:
        dq.checked(rows, F.col("id"), checks)
    assert e.value.metrics["bad"] == m["bad"]
    assert dq.checked(rows.filter("id = 2"), F.col("id"), checks).collect() == rows.filter("id = 2").collect()
    assert dq.checked(rows.limit(0), F.col("id"), checks).count() == 0


def test_pages_of_claimants(spark):
    rows = [("host", t, f"p{i:03}") for i in range(50) for t in ("A", "a", "b")] + [("host", "c", "p1"), ("env", "a", "p2")]
    got = co.token_claims(spark.createDataFrame(rows, "signal string, token string, platform string").repartition(4), 7).collect()
    assert {(r.signal, r.token, r.platforms) for r in got} == {("host", "a", 50), ("host", "b", 50)} and len(got) == 16
    for t in "ab":
        assert [p for r in sorted((r for r in got if r.token == t), key=lambda r: r.page) for p in r.claimants] == [f"p{i:03}" for i in range(50)]


def test_digest_trees(spark):
    """The same tree for any partitioning; a change is found, and proofs of others' leaves or
    texts do not give the root."""
    rows = [(f"f{i}", None if i == 3 else "" if i == 4 else f"text {i % 9}") for i in range(400)]
    df = spark.createDataFrame(rows, "name string, body string")
    leaf = lambda d: dg.leaves(d, "name", F.col("body"))
    nodes = {n: {(r.level, r.prefix): r.digest for r in dg.merkle(leaf(df.repartition(n))).collect()} for n in (1, 7)}
    assert nodes[1] == nodes[7] and sum(k[0] == 0 for k in nodes[1]) == 1
    depth = max(k[0] for k in nodes[1])
    other = df.withColumn("body", F.when(F.col("name") == "f17", "new").when(F.col("name") == "f3", "").otherwise(F.col("body"))).filter("name <> 'f5'")
    before, after = dg.merkle(leaf(df), depth), dg.merkle(leaf(other), depth)
    place = lambda n: hashlib.sha256(n.encode()).hexdigest()
    assert {r.prefix for r in dg.changed(before, after).collect()} == {place(n)[:k] for n in ("f17", "f3", "f5") for k in range(depth + 1)}
    assert dg.changed(before, before).count() == 0
    proofs = dg.proofs(other.select("name").filter("name in ('f17', 'f18')"), leaf(other), after, depth)
    root = [r.digest for r in after.filter("level = 0").collect()]
    given = lambda digest: [r.g for r in proofs.select(dg.root_of(digest, F.col("place"), F.col("beside"), F.col("path"), depth).alias("g")).collect()]
    assert given(F.col("digest")) == root * 2 and root[0] not in given(F.sha2(F.col("digest"), 256))
    assert dg.merkle(leaf(df.limit(0))).count() == 0


def test_multiset_hashes_merge(spark):
    df = spark.createDataFrame([(i % 3, f"t{i % 5}") for i in range(60)] + [(9, None)], "k int, t string")
    whole = {r.k: (r.n, r.h) for r in dg.sums(df, ["k"], "t").select("k", "n", dg.multiset_hash().alias("h")).collect()}
    parts = dg.sums(df.filter("t < 't2'"), ["k"], "t").union(dg.sums(df.filter("t >= 't2' or t is null"), ["k"], "t"))
    assert {r.k: (r.n, r.h) for r in dg.merged(parts, ["k"]).select("k", "n", dg.multiset_hash().alias("h")).collect()} == whole
    assert whole[9][0] == 0 and whole[0] == whole[1] == whole[2] != whole[9] and whole[0][0] == 20  # the same items under three keys


def test_ignore_patterns(spark):
    """Every kind of rule against a matcher of whole segments."""
    def fits(segments, rule):
        if not rule:
            return not segments
        if rule == ["**"]:
            return True  # a last `**` is the place and everything below
        if rule[0] == "**":
            return fits(segments, rule[1:]) or bool(segments) and fits(segments[1:], rule)
        return bool(segments) and fnmatch.fnmatchcase(segments[0], rule[0]) and fits(segments[1:], rule[1:])

    names = ["a", "b.py", "ab", "x+y", "(c)"]
    paths = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(names, repeat=n)]
    rules = ["a", "a/*", "a/**", "**/b.py", "a/**/b.py", "*/ab/**", "**/a/**/ab", "a?/*", "**/*.py", "x+y/(c)/*", "*", "a*/**/*.py", "**/a/**", " ", "a/b.py/x+y"]
    files = spark.createDataFrame([(f"p{i}", p) for i in range(len(rules)) for p in paths], "project_id string, rel string")
    table = spark.createDataFrame([(f"p{i}", 0, r) for i, r in enumerate(rules)], "project_id string, ordinal int, path string")
    got = {}
    for r in fs.match_ignores(files, table, wildcards=True).collect():
        got.setdefault(r.project_id, set()).add(r.rel)
    plain = {(r.project_id, r.rel) for r in fs.match_ignores(files, table).collect()}
    assert {int(p[1:]) for p, _ in plain} == {i for i, r in enumerate(rules) if not re.search("[*?]", re.sub(r"/[*]+$", "", r)) and r.strip()}
    assert plain == {(f"p{i}", rel) for i in {int(p[1:]) for p, _ in plain} for rel in got[f"p{i}"]}
    for i, rule in enumerate(rules):
        want = {p for p in paths if rule.strip() and fits(p.split("/"), rule.split("/"))}
        assert got.get(f"p{i}", set()) == want, rule
    # the first rule names a file
    both = spark.createDataFrame([("p0", 2, "a/**"), ("p0", 1, "**/b.py")], "project_id string, ordinal int, path string")
    assert {r.rel: r.rule_path for r in fs.match_ignores(files.filter("rel in ('a/b.py', 'a/a')"), both, wildcards=True).collect()} == {"a/b.py": "**/b.py", "a/a": "a/**"}


def test_a_rule_that_hides_most_files_warns(spark):
    files = spark.createDataFrame([("p", f"src/{i}.py", 1) for i in range(6)] + [("p", "a.txt", 1), ("q", "src/x", 1), ("q", "y", 1)], "project_id string, rel string, length long").withColumn("modification_time", F.lit(None).cast("timestamp"))
    rules = spark.createDataFrame([("p", 0, "src/**"), ("q", 0, "src/**")], "project_id string, ordinal int, path string")
    marked = fs.mark_ignores(files, rules)
    assert [tuple(r) for r in fs.ignore_warnings(marked).collect()] == [("p", "E-SCAN-020", "src/**")]
    texts = spark.createDataFrame([], "project_id string, rel string, length long, text string")
    probed = spark.createDataFrame([], wt.PROBE_SCHEMA)
    scanned = check.scan(files, ignores=rules, texts=texts, probed=probed)
    assert ("p", "E-SCAN-020", "src/**") in {tuple(r) for r in scanned.warnings.collect()}
    placed = graph.in_order(scanned.warnings.withColumn("message", F.lit("")), graph.WARNING_ORDER).collect()
    for p in {r.project_id for r in placed}:
        own = sorted((r for r in placed if r.project_id == p), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda r: (r.code, r.path))


def test_metadata_of_declarations_stays(spark):
    text = json.dumps({"name": "x", "dependencies": {"a": "^1.0.0"}, "devDependencies": {"b": "2.0.0"}})
    files = spark.createDataFrame([("p", "package.json", len(text))], "project_id string, rel string, length long").withColumn("modification_time", F.lit(None).cast("timestamp"))
    texts = spark.createDataFrame([("p", "package.json", len(text), text)], "project_id string, rel string, length long, text string")
    scanned = check.scan(files, texts=texts, probed=spark.createDataFrame([], wt.PROBE_SCHEMA))
    assert {r.name: r.metadata for r in scanned.dependencies.collect()} == {"a": {"version_is_requirement": "true"}, "b": {"dev": "true"}}


def test_suggestions_cannot_touch_findings(spark):
    answer = json.dumps({"job": "explain", "findings": [{"id": "f1", "explanation": "x\u0007y"}, {"id": "nope", "explanation": "z"}],
                         "overrides": [{"finding_id": "f1", "op": "delete"}]})
    a = spark.createDataFrame([("p", 1, "explain", answer), ("p", 2, "explain", "no json"), ("p", 3, "explain", "")], "project_id string, seq int, job string, text string")
    items = sg.parse_answers(a)
    known = spark.createDataFrame([("p", "f1")], "project_id string, item_id string")
    assert [(r.item_id, r.body) for r in sg.admit(items, known, known).collect()] == [("f1", "xy")]
    assert sorted((r.item_id, r.message) for r in sg.refused(items, known, known).collect()) == [("f1", "refused to remove"), ("nope", "unknown id for explanation")]
    assert sg.rejected_answers(a).count() == 2
    assert [one(spark, x, sg.alternative_licence) for x in ("a (MIT)", "(a) b (x y)", "plain", "a ()")] == ["MIT", "x y", "plain", "a ()"]


def test_block_files_are_read_inside_their_row(spark):
    go = "module m\n\nrequire (\n  // x\n  a.b/c v1.0.0 // indirect\n\n  a.b/d v1.2.0\n)\nrequire a.b/c v9.0.0\nreplace a.b/d v1.2.0 => ./local\nreplace (\n  a.b/d => e.f/g v3.0.0\n"
    lock = "# c\nversion = 3\n\n[[package]]\n# name = \"no\"\nname = \"root\"\nversion = \"0.1\"\ndependencies = [\n \"x 1.0\",\n \"y\",\n]\n\n[[package]]\nversion = \"1.0\"\nname = \"x\"\nsource = \"r\"\n\n[[package]]\nname = \"z\"\nsource = \"r\"\n\n[metadata]\nname = \"no\"\n"
    files = spark.createDataFrame([("p", "f", go), ("q", "f", lock), ("r", "f", ""), ("s", "f", "require (")], "project_id string, rel string, text string")
    got = mf.go_mod(files.filter("project_id in ('p', 'r', 's')"))
    assert sorted((r.name, r.version, r.direct, r.local, r.line) for r in got.collect()) == [("a.b/c", "v1.0.0", False, False, 5), ("a.b/d", "v1.2.0", True, True, 7)]
    crates = mf.cargo_lock(files.filter("project_id in ('q', 'r')"))
    assert sorted((r.name, r.version, r.direct, r.local, r.line) for r in crates.collect()) == [("root", "0.1", False, True, 6), ("x", "1.0", True, False, 15), ("z", "", False, False, 19)]
    for df in (got, crates, mf.poetry_lock(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
