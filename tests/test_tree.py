"""Listing and header reading in tasks."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

import projects
from lexfleet.sources import files as fs, tree, weights as wt


def made(root, paths):
    for p, content in paths.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "wb") as f:
            f.write(content)


@pytest.fixture
def fleet(tmp_path):
    """A hot project, a deep one, an empty one, one that is only pruned folders, a link
    that leads back, a file beside the projects."""
    paths = {f"hot/d{i % 7}/e{i % 3}/f{i}.txt": b"x" * i for i in range(300)}
    paths |= {"deep/" + "n/" * 40 + "f.txt": b"1", "deep/é b.txt": b"12", "skip/.git/config": b"", "skip/dist/app.js": b"", "skip/node_modules/a/node_modules/b/x.js": b"", "stray.txt": b""}
    made(tmp_path, paths)
    os.makedirs(tmp_path / "empty")
    os.symlink(tmp_path / "hot", tmp_path / "deep/back")
    return str(tmp_path), paths


@pytest.mark.parametrize("budget,buckets", [(100_000, 1), (10, 3), (1, 8)])
def test_every_file_is_listed(spark, fleet, budget, buckets):
    root, paths = fleet
    for base in (root, "file://" + root, root + "/"):
        got = {(r.project_id, r.rel): (r.length, r.path) for r in tree.list_tree(spark, base, buckets, budget).collect()}
        want = {tuple(p.split("/", 1)): (len(c), f"{base.rstrip('/')}/{p}") for p, c in paths.items() if not p.startswith("skip/") and "/" in p}
        assert got == want


def test_listing_matches_the_file_reader(spark, fleet):
    """The same rows as Spark's own listing after pruning, which leaves out empty files."""
    root, _ = fleet
    os.remove(root + "/stray.txt")
    columns = ["project_id", "rel", "length", "modification_time"]
    a = fs.prune(fs.list_files(spark, root)).filter("not rel like 'back/%'").select(*columns)
    b = tree.list_tree(spark, root, 4, 50).filter("length > 0").select(*columns)
    assert sorted(a.withColumn("modification_time", F.date_trunc("second", "modification_time")).collect()) == sorted(b.withColumn("modification_time", F.date_trunc("second", "modification_time")).collect())


def test_filters_reach_the_walk(spark, fleet):
    root, _ = fleet
    tree.register(spark)
    df = spark.read.format("fleet_files").load(root).filter("project_id = 'deep' and length < 2")
    assert [r.length for r in df.collect()] == [1]
    assert df.rdd.getNumPartitions() == 1  # one named project instead of 64 buckets
    assert spark.read.format("fleet_files").load(root).filter("project_id in ('empty', 'none')").count() == 0


def test_pushed_filters():
    r = tree.HeaderReader({"path": "/x"})
    rest = [EqualTo(("rel",), "a")]
    asked = [In(("project_id",), ("a", "b")), EqualTo(("project_id",), "b"), GreaterThan(("length",), 9), LessThanOrEqual(("length",), 99), In(("format",), ("GGUF", "ONNX")), EqualTo(("format",), "GGUF")]
    assert list(r.pushFilters(asked + rest)) == rest
    assert (r.only, r.least, r.most, r.formats) == ({"b"}, 10, 99, {"GGUF"})
    assert r.partitions() == [tree.Named("b")]


def test_weight_headers(spark, tmp_path):
    """Small files without a telling name are found; broken headers say so; the filters
    give what the same filters give on all rows."""
    gguf = projects.gguf(general__license="mit")
    files = {"a/x": gguf, "a/y.bin": gguf[:40], "a/node_modules/z.gguf": gguf, "b/t.txt": b"hello", "b/e": b"", "b/s": projects.SAFETENSORS, "b/m.onnx": b"\x08\x07" + b"\0" * 20, "c/m.dat": b"\x08\x07" + b"\0" * 20}
    made(tmp_path, files)
    root = str(tmp_path)
    everything = tree.weight_headers(spark, root, 3).collect()
    assert {(r.project_id, r.rel, r.format, r.gguf_licence, r.gguf_truncated) for r in everything} == {
        ("a", "x", "GGUF", "mit", False), ("a", "y.bin", "GGUF", "", True), ("b", "s", "SafeTensors", "", False), ("b", "m.onnx", "ONNX", "", False)}
    for condition in ("format = 'GGUF'", "length > 30", "length <= 40 and format in ('GGUF', 'ONNX')", "length = 22", "project_id = 'b' and format <> 'ONNX'", "format is null"):
        want = [r.rel for r in spark.createDataFrame(everything, tree.HEADERS).filter(condition).collect()]
        assert sorted(r.rel for r in tree.weight_headers(spark, root, 3).filter(condition).collect()) == sorted(want), condition
    probed = wt.inventory(wt.probe(tree.list_tree(spark, root, 2)))
    assert {(r.project_id, r.rel, r.format) for r in probed.collect()} == {(r.project_id, r.rel, r.format) for r in everything}


def test_write_files_again(spark, tmp_path):
    df = spark.createDataFrame([("p/a/x", b"1"), ("p/y", None)], "rel string, content binary")
    root = str(tmp_path / "out")
    assert tree.write_files(df, root) == 2 and tree.write_files(df, root) == 2
    assert sorted((r.rel, r.length) for r in tree.list_tree(spark, root).collect()) == [("a/x", 1), ("y", 0)]
