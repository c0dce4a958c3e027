"""Model weight files: found by their first bytes, licensed by what stands near.

The listing never loads content. Of every file the first bytes are read, whatever its
name or size, and then only a header (or the directory of a zip), in pieces.
"""

import struct
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexfleet.functions import fixed, ids, spdx as spdx_fn, text as tx
from lexfleet.operators.ownership import containing_scope
from lexfleet.session import map_in_pandas, fact_join
from lexfleet.sources.files import inside_dependency_dir, open_path

PROBE_SCHEMA = "project_id string, rel string, length long, format string, has_pickle boolean, gguf_licence string, gguf_link string, gguf_truncated boolean"


# fixed values: first bytes of the formats; a zip counts with a pickle in its directory
PICKLED_ZIP = "PyTorch (zip)"
MAGIC = [
    (b"GGUF", "GGUF"), (b"\x89HDF\r\n\x1a\n", "HDF5"), (b"\x80\x02", "Pickle"), (b"\x80\x03", "Pickle"), (b"\x80\x04", "Pickle"), (b"\x80\x05", "Pickle"),
    (b"PK\x03\x04", PICKLED_ZIP),
]


def candidates(files: DataFrame) -> DataFrame:
    """Files whose first bytes are read: all of them but those of dependency trees."""
    return files.filter(~inside_dependency_dir())


# fixed values: width in bytes of the plain value types; 8 is a string, 9 an array
_WIDTH = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
_STRING, _ARRAY = 8, 9
_LICENCE_KEYS, _LINK_KEY = (b"general.license", b"general.license.name"), b"general.license.link"


class _Header:
    """Reads a file from front to back in pieces; what is passed over is not read."""

    def __init__(self, f, size):
        self.f, self.size, self.at, self.held, self.start = f, size, 0, b"", 0

    def skip(self, n):
        self.at += n
        if self.at > self.size:
            raise EOFError

    def take(self, n):
        end = self.at + n
        if end > self.size:
            raise EOFError
        if not self.start <= self.at <= end <= self.start + len(self.held):
            self.held, self.start = self.f.read_at(min(max(n, fixed.WEIGHT_READ_BYTES), self.size - self.at), self.at), self.at
        part = self.held[self.at - self.start : end - self.start]
        self.at = end
        return part

    def number(self, kind):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def skip_values(self, kind, count=1):
        """Pass over values of any nesting: open arrays wait on a list."""
        todo = [(kind, count)]
        while todo:
            kind, count = todo.pop()
            if kind == _STRING:
                for _ in range(count):
                    self.skip(self.number("<Q"))
            elif kind != _ARRAY:
                self.skip(_WIDTH[kind] * count)
            elif count:
                todo += [(_ARRAY, count - 1), (self.number("<I"), self.number("<Q"))]


def gguf_metadata(header):
    """(licence, link, truncated); what stands before an early end counts."""
    licence = link = b""
    try:
        header.skip(16)
        for _ in range(header.number("<Q")):
            key = header.take(header.number("<Q"))
            kind = header.number("<I")
            if kind == _STRING and (key in _LICENCE_KEYS or key == _LINK_KEY):
                value = header.take(header.number("<Q"))
                licence, link = (licence, value) if key == _LINK_KEY else (licence or value, link)
            else:
                header.skip_values(kind)
    except (EOFError, KeyError):
        return licence.decode("utf-8", "replace"), link.decode("utf-8", "replace"), True
    return licence.decode("utf-8", "replace"), link.decode("utf-8", "replace"), False


def _has_pickle(f, size):
    """Whether a zip's directory names a pickle; only the directory is read."""
    if size < 22:  # no room for a directory's end
        return False
    try:
        return any(n.rsplit("/", 1)[-1] == "data.pkl" for n in zipfile.ZipFile(f).namelist())
    except zipfile.BadZipFile:
        return False


def format_of(head: bytes, size: int, rel: str):
    """What the first bytes say, before a zip's directory is read."""
    if len(head) < 4:
        return None
    if len(head) >= 9 and head[8:9] == b"{" and 0 < int.from_bytes(head[:8], "little") <= size - 8:
        return "SafeTensors"
    for magic, name in MAGIC:
        if head.startswith(magic):
            return name
    return "ONNX" if head[:1] == b"\x08" and rel.lower().endswith(".onnx") else None


def read_header(f, size, rel, formats=None):
    """(format, has_pickle, licence, link, truncated) of a weight file, None for any other.
    Nothing but the first bytes is read of formats that are not asked for."""
    head = f.read_at(min(size, fixed.WEIGHT_MAGIC_BYTES), 0)
    name = format_of(head, size, rel)
    if name is None or formats is not None and name not in formats:
        return None
    if name == "GGUF":
        return (name, False, *gguf_metadata(_Header(f, size)))
    if name == PICKLED_ZIP:
        return (name, True, "", "", False) if _has_pickle(f, size) else None
    return name, False, "", "", False


def _probe(batches):
    for pdf in batches:
        out = []
        for project, rel, length, path in pdf[["project_id", "rel", "length", "path"]].itertuples(index=False):
            with open_path(path) as f:
                header = read_header(f, length, rel)
            if header is not None:
                out.append((project, rel, length, *header))
        yield pd.DataFrame(out, columns=["project_id", "rel", "length", "format", "has_pickle", "gguf_licence", "gguf_link", "gguf_truncated"])


def truncated_headers(probed: DataFrame) -> DataFrame:
    """Metadata that ends before its count is reached."""
    return probed.filter("gguf_truncated").select("project_id", F.lit("E-SCAN-012").alias("code"), F.col("rel").alias("path"))


def probe(files: DataFrame, partitions=None) -> DataFrame:
    """`files` with `path`: opens each candidate and reads only its header or directory."""
    todo = candidates(files).select("project_id", "rel", "length", "path")
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_in_pandas(todo.repartition(n, "path"), _probe, PROBE_SCHEMA)


def inventory(probed: DataFrame) -> DataFrame:
    return probed.filter(F.col("format").isNotNull())


# ---- licence sources near a weight file -------------------------------------------------

LICENCE_SOURCE_SCHEMA = "project_id string, dir string, rel string, rank int, spdx string, raw string, source string, confidence string"
# fixed values: precedence of the sources, strongest first
RANK = {"in_file": 0, "config": 1, "front_matter": 2, "licence_file": 3, "model_card": 4, "prose": 5}
SIBLING_LICENCE_NAMES = ["license", "license.md", "license.txt", "copying", "copying.md"]


def _resolved(df: DataFrame, raw: Column, source: str, kind: str, confidence: str, order=None) -> DataFrame:
    ref = df.withColumn("_r", spdx_fn.licence_ref(raw, source))
    return ref.filter("_r.resolved").select(
        "project_id", tx.dir_name("rel").alias("dir"), "rel", F.lit(RANK[kind]).alias("rank"),
        (F.lit(0) if order is None else order).alias("name_rank"), F.col("_r.spdx").alias("spdx"), F.col("_r.raw").alias("raw"),
        F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def licence_sources(texts: DataFrame) -> DataFrame:
    """Small text files (project_id, rel, text) that state a licence for what stands near them."""
    base = F.lower(tx.base_name("rel"))
    t = texts.withColumn("_base", base)
    config = t.filter(F.col("_base") == "config.json")
    config = _resolved(config, tx.config_json_licence_raw("text"), "model_card", "config", "high")

    readme = t.filter(F.col("_base") == "readme.md").select("project_id", "rel", F.posexplode(tx.front_matter_licence_raw("text")).alias("pos", "value"))
    readme = _resolved(readme, F.col("value"), "model_card", "front_matter", "high", F.col("pos"))

    names = F.array(*[F.lit(n) for n in SIBLING_LICENCE_NAMES])
    lic = t.filter(F.col("_base").isin(SIBLING_LICENCE_NAMES)).withColumn("norm", tx.normalise_text("text"))
    lic = lic.select("project_id", "rel", "_base", F.explode(F.array_compact(F.array(tx.recognise_licence("norm")))).alias("spdx"))
    lic = lic.select("project_id", tx.dir_name("rel").alias("dir"), "rel", F.lit(RANK["licence_file"]).alias("rank"),
                     (F.array_position(names, F.col("_base")) - 1).cast("int").alias("name_rank"), "spdx", F.col("spdx").alias("raw"),
                     F.lit("weight_sibling_licence").alias("source"), F.lit("high").alias("confidence"))

    md = t.filter(F.col("_base").endswith(".md") & (F.col("_base") != "readme.md")).withColumn("low", F.lower("text"))
    md = md.select("project_id", "rel", "_base", F.explode(F.array_compact(F.array(
        F.when(tx.prose_licence("low").isNotNull(), F.struct(tx.prose_licence("low").alias("spdx"), tx.prose_needle("low").alias("raw")))))).alias("p"))
    card = F.col("_base") == "model_card.md"
    md = md.select("project_id", tx.dir_name("rel").alias("dir"), "rel", F.when(card, RANK["model_card"]).otherwise(RANK["prose"]).alias("rank"),
                   F.lit(0).alias("name_rank"), "p.spdx", "p.raw", F.when(card, "model_card").otherwise("weight_prose").alias("source"),
                   F.when(card, "medium").otherwise("low").alias("confidence"))
    return config.unionByName(readme).unionByName(lic).unionByName(md)


def unparseable_configs(texts: DataFrame) -> DataFrame:
    c = texts.filter(F.lower(tx.base_name("rel")) == "config.json")
    bad = ~F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    return c.filter(bad).select("project_id", F.lit("E-PARSE-005").alias("code"), F.col("rel").alias("path"))


def pick_source(weights: DataFrame, sources: DataFrame) -> DataFrame:
    """Best source per weight file: by rank, then name, then own directory before the
    root. `weights`: (project_id, rel, …).

    Sources shrink to one row per directory before they meet the weight files, so a
    directory full of both never yields all its pairs.
    """
    body = F.struct("rank", "name_rank", F.col("rel").alias("source_rel"), "spdx", "raw", "source", "confidence")
    best = sources.groupBy("project_id", "dir").agg(F.min_by(body, F.struct("rank", "name_rank", "rel")).alias("s"))
    w = weights.select("project_id", "rel", tx.dir_name("rel").alias("_wdir"))
    probes = w.select("project_id", "rel", "_wdir", F.explode(F.array_distinct(F.array("_wdir", F.lit(".")))).alias("dir"))
    hit = fact_join(probes, best, ["project_id", "dir"], "inner")
    far = (F.col("dir") != F.col("_wdir")).cast("int")
    # prose files are taken in path order, the others by name and nearness
    order = F.struct("s.rank", "s.name_rank", F.when(F.col("s.rank") == RANK["prose"], F.lit(0)).otherwise(far).alias("far"), "s.source_rel")
    return hit.groupBy("project_id", "rel").agg(F.min_by("s", order).alias("best"))


def weight_dependencies(found: DataFrame, sources: DataFrame, units: DataFrame) -> DataFrame:
    """Weight rows with the licence of their best source; metadata inside the file wins."""
    infile = found.withColumn("_r", spdx_fn.licence_ref("gguf_licence", "weight_metadata"))
    chosen = infile.join(pick_source(found, sources), ["project_id", "rel"], "left")
    chosen = containing_scope(chosen, units)
    own = (F.col("format") == "GGUF") & F.col("_r.resolved")
    has = own | F.col("best").isNotNull()
    pick = lambda a, b, none: F.when(own, a).when(F.col("best").isNotNull(), F.col(f"best.{b}")).otherwise(none)
    return chosen.select(
        "project_id", ids.local_id("weights", "rel").alias("id"), F.lit("weights").alias("kind"), tx.base_name("rel").alias("name"),
        F.lit("").alias("version"), F.lit("weights").alias("ecosystem"), "scope", F.lit(False).alias("direct"),
        pick(F.col("_r.spdx"), "spdx", F.lit("")).alias("spdx"), pick(F.col("_r.raw"), "raw", F.lit("")).alias("raw"),
        pick(F.lit("weight_metadata"), "source", F.lit("unresolved")).alias("licence_source"),
        F.when(own, F.col("_r.expression")).otherwise(F.lit(False)).alias("expression"), has.alias("resolved"),
        pick(F.lit("high"), "confidence", F.lit("none")).alias("licence_confidence"),
        F.lit(None).cast("string").alias("declared_licence"), F.col("rel").alias("evidence_path"), F.lit(0).alias("evidence_line"),
        "format", F.when(own & (F.col("gguf_link") != ""), F.col("gguf_link")).alias("licence_link"))


def licence_not_found(weights: DataFrame) -> DataFrame:
    """Undetermined rows of weight files nobody states a licence for."""
    return weights.filter(~F.col("resolved")).select(
        "project_id", "id", "kind", F.lit("licence_not_found").alias("reason"), F.lit("E-SCAN-010").alias("error_code"),
        "evidence_path", "evidence_line")
