"""Queries that read trees of files. The trees are written from whole tables first."""

import io
import json
import struct
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from lexfleet.plans import bindings as b
from lexfleet.plans.registry import query
from lexfleet.session import ensure_checkpoint_dir, ship
from lexfleet.sources import tree, weights as wt


def _place(spark, name):
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _project(df):
    return F.concat(F.lit("s-"), F.coalesce("source", F.lit("none")))


@query
def listed_files(spark, sf):
    """Files written from all documents, one project for each source, found by the walk of
    the tasks: how many in each directory, and their bytes. Build folders hold a copy of
    every seventh document and are not descended."""
    d = b.table(spark, sf, "documents").select("doc_id", "text", _project("source").alias("p"))
    place = F.concat_ws("/", "p", F.when(F.col("doc_id") % 7 == 0, "dist").otherwise("docs"), F.concat(F.lit("k"), (F.col("doc_id") % 5).cast("string")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    root = _place(spark, "listed")
    tree.write_files(d.select(place.alias("rel"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), root)
    found = tree.list_tree(spark, root, buckets=8, budget=500)
    return found.groupBy("project_id", F.regexp_extract("rel", "^(.*)/[^/]*$", 1).alias("directory")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def _text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<Q", len(raw)) + raw


def weight_file(doc_id: int, text: str) -> bytes:
    """A file around a document's text: five shapes by its id."""
    body, shape = text.encode(), doc_id % 5
    if shape == 0:
        licence = ["mit", "apache-2.0", ""][doc_id % 3]
        entries = _text("general.name") + struct.pack("<I", 8) + _text(text) + _text("general.license") + struct.pack("<I", 8) + _text(licence)
        return b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + entries
    if shape == 1:
        header = json.dumps({"__metadata__": {"text": text}}).encode()
        return struct.pack("<Q", len(header)) + header + body
    if shape in (2, 3):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/data.pkl" if shape == 2 else "word/document.xml", body)
        return out.getvalue()
    return b"text " + body


def weight_tree(spark, sf, name):
    """Weight and other files of all documents, none of which its name gives away."""
    ship(spark)
    d = b.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _project("source").alias("p"))

    def build(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256).to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "rel": pa.array([f"{r['p']}/m/{r['doc_id']}.dat" for r in rows]), "content": pa.array([weight_file(r["doc_id"], r["text"]) for r in rows], pa.binary())})

    root = _place(spark, name)
    tree.write_files(d.mapInArrow(build, "rel string, content binary"), root)
    return root


@query
def weight_inventory(spark, sf):
    """Weight files told by their first bytes, read in tasks."""
    found = tree.weight_headers(spark, weight_tree(spark, sf, "weights"), buckets=8)
    return found.select("project_id", "rel", "format", "has_pickle", "gguf_licence", "gguf_truncated")


@query
def weight_inventory_pushed(spark, sf):
    """The same with filters that go down to the reader: format, size and project."""
    found = tree.weight_headers(spark, weight_tree(spark, sf, "pushed"), buckets=8)
    some = found.filter(F.col("format").isin("GGUF", "PyTorch (zip)") & (F.col("length") >= 200) & (F.col("project_id") != "s-none"))
    return some.groupBy("project_id", "format").agg(F.count("*").alias("files"), F.min(F.col("length") >= 200).alias("large"))


@query
def weight_licences(spark, sf):
    """Weight rows with the licence that stands in the file; those without one are
    undetermined as well."""
    root = weight_tree(spark, sf, "licences")
    found = wt.inventory(wt.probe(tree.list_tree(spark, root, buckets=8)))
    texts = spark.createDataFrame([], "project_id string, rel string, text string")
    units = spark.createDataFrame([], "project_id string, dir string, ecosystem string")
    rows = wt.weight_dependencies(found, wt.licence_sources(texts), units)
    open_rows = wt.licence_not_found(rows).select("project_id", "id", "reason", "error_code")
    return rows.join(open_rows, ["project_id", "id"], "left").select("project_id", "id", "name", "spdx", "licence_source", "resolved", "format", "reason", "error_code")
