"""Trees of files read in tasks: listing, and the headers of weight files.

Two data sources in Python, `fleet_files` and `fleet_weights`, over `root/<project>/...`.
Each partition is a bucket of projects: a task lists the root's first level, keeps the
projects whose name falls into its bucket and walks them. The driver holds no index of
files and no list of projects.

    spark.read.format("fleet_files").option("buckets", 64).load(root)

A walk ends after `budget` files; directories it did not open are rows of their own
(`is_dir`). `list_tree` deals them out again, round by round, so one huge project is
spread over all tasks. Generated and version-control directories are not descended.

Filters on project_id go down to the walk: other projects are not listed. Filters on
length and format go down to the header reader: files of other sizes are not opened,
and of other formats only the first bytes are read.
"""

import os
import re
from collections import deque
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from lexfleet.functions import fixed
from lexfleet.session import materialise, ship
from lexfleet.sources import files as fs, weights as wt

FILES = "project_id string, rel string, length long, modification_time timestamp, path string, is_dir boolean"
HEADERS = "project_id string, rel string, length long, path string, format string, has_pickle boolean, gguf_licence string, gguf_link string, gguf_truncated boolean"
BUDGET = 100_000  # files of one walk
BUCKETS = 64
ROWS = 4096  # of an Arrow batch

_FILES = pa.schema([("project_id", pa.string()), ("rel", pa.string()), ("length", pa.int64()), ("modification_time", pa.timestamp("us", tz="UTC")), ("path", pa.string()), ("is_dir", pa.bool_())])
_HEADERS = pa.schema([("project_id", pa.string()), ("rel", pa.string()), ("length", pa.int64()), ("path", pa.string()), ("format", pa.string()), ("has_pickle", pa.bool_()),
                      ("gguf_licence", pa.string()), ("gguf_link", pa.string()), ("gguf_truncated", pa.bool_())])


def file_system(root: str):
    """A pyarrow file system and the path inside it."""
    from pyarrow import fs as pfs

    if root.startswith(("s3a://", "s3n://")):
        root = "s3" + root[3:]
    if root.startswith("file:"):
        root = "/" + root[len("file:"):].lstrip("/")
    return pfs.FileSystem.from_uri(root) if "://" in root else (pfs.LocalFileSystem(), root)


class Tree:
    """One tree, walked from some of its directories."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.system, inner = file_system(self.root)
        self.inner = inner.rstrip("/")
        self.pruned = re.compile(fs.PRUNED_DIRS).search

    def _children(self, place: str):
        """Entries of a directory by name; links are not followed."""
        from pyarrow import fs as pfs

        found = self.system.get_file_info(pfs.FileSelector(f"{self.inner}/{place}".rstrip("/")))
        local = isinstance(self.system, pfs.LocalFileSystem)
        for info in sorted(found, key=lambda i: i.base_name):
            if not (local and os.path.islink(info.path)):
                yield info, info.type == pfs.FileType.Directory

    def projects(self):
        return (info.base_name for info, is_dir in self._children("") if is_dir)

    def walk(self, places, budget):
        """(project, rel, FileInfo or None) of the files below some directories `project` or
        `project/rel`. Directories left when the budget is spent come with None."""
        todo, seen = deque(places), 0
        while todo:
            place = todo.popleft()
            project, _, base = place.partition("/")
            if seen >= budget:
                yield project, base, None
                continue
            for info, is_dir in self._children(place):
                rel = f"{base}/{info.base_name}" if base else info.base_name
                if not is_dir:
                    seen += 1
                    yield project, rel, info
                elif not self.pruned(rel + "/"):
                    todo.append(f"{project}/{rel}")

    def path(self, project, rel):
        return f"{self.root}/{project}/{rel}" if rel else f"{self.root}/{project}"

    def listing(self, places, budget):
        rows = []
        for project, rel, info in self.walk(places, budget):
            rows.append((project, rel, info and info.size, info and info.mtime, self.path(project, rel), info is None))
            if len(rows) >= ROWS:
                yield _batch(rows, _FILES)
                rows = []
        if rows:
            yield _batch(rows, _FILES)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class Bucket(InputPartition):
    number: int
    of: int

    def holds(self, project: str) -> bool:
        return crc32(project.encode()) % self.of == self.number


@dataclass
class Named(InputPartition):
    project: str


class TreeReader(DataSourceReader):
    """Partitions by bucket of projects, or by project where a filter names them."""

    def __init__(self, options):
        self.root = options["path"]
        self.buckets, self.budget = int(options.get("buckets", BUCKETS)), int(options.get("budget", BUDGET))
        self.only = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("project_id",):
                named = set(f.value if isinstance(f, In) else [f.value])
                self.only = named if self.only is None else self.only & named
            elif not self.take(f):
                yield f

    def take(self, f: Filter) -> bool:
        """Whether the reader applies a filter itself."""
        return False

    def partitions(self):
        if self.only is not None:
            return [Named(p) for p in sorted(x for x in self.only if x)]
        return [Bucket(i, self.buckets) for i in range(self.buckets)]

    def places(self, tree, partition):
        if isinstance(partition, Bucket):
            return [p for p in tree.projects() if partition.holds(p)]
        return [p for p in tree.projects() if p == partition.project]

    def read(self, partition):
        tree = Tree(self.root)
        yield from tree.listing(self.places(tree, partition), self.budget)


class FleetFiles(DataSource):
    @classmethod
    def name(cls):
        return "fleet_files"

    def schema(self):
        return FILES

    def reader(self, schema):
        return TreeReader(self.options)


class HeaderReader(TreeReader):
    """Weight files by their first bytes, whatever their size or name."""

    def __init__(self, options):
        super().__init__(options)
        self.least, self.most, self.formats = 0, None, None

    def take(self, f):
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("length",):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            return True
        if isinstance(f, (EqualTo, In)) and f.attribute == ("format",):
            named = set(f.value if isinstance(f, In) else [f.value])
            self.formats = named if self.formats is None else self.formats & named
            return True
        return False

    def read(self, partition):
        tree, rows = Tree(self.root), []
        for project, rel, info in tree.walk(self.places(tree, partition), float("inf")):
            if info.size < self.least or self.most is not None and info.size > self.most or fs.in_dependency_dir(rel):
                continue
            with tree.system.open_input_file(info.path) as f:
                header = wt.read_header(f, info.size, rel, self.formats)
            if header is not None:
                rows.append((project, rel, info.size, tree.path(project, rel), *header))
            if len(rows) >= ROWS:
                yield _batch(rows, _HEADERS)
                rows = []
        if rows:
            yield _batch(rows, _HEADERS)


class FleetWeights(DataSource):
    @classmethod
    def name(cls):
        return "fleet_weights"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both sources known to a session and their code to its executors."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FleetFiles)
    spark.dataSource.register(FleetWeights)


def list_tree(spark: SparkSession, root: str, buckets=BUCKETS, budget=BUDGET) -> DataFrame:
    """All files below root/<project>: project_id, rel, length, modification_time, path.
    Every round walks the directories that the round before left, dealt out evenly, so
    its rows are staged."""
    register(spark)
    rows = materialise(spark.read.format("fleet_files").option("buckets", buckets).option("budget", budget).load(root))
    files = rows.filter("not is_dir")

    def walk(batches):
        tree = Tree(root)
        for b in batches:
            for project, rel in zip(b.column("project_id").to_pylist(), b.column("rel").to_pylist()):
                yield from tree.listing([f"{project}/{rel}" if rel else project], budget)

    left = rows.filter("is_dir")
    while not left.isEmpty():
        rows = materialise(left.select("project_id", "rel").repartition(buckets, "project_id", "rel").mapInArrow(walk, FILES))
        files, left = files.union(rows.filter("not is_dir")), rows.filter("is_dir")
    return files.drop("is_dir")


def weight_headers(spark: SparkSession, root: str, buckets=BUCKETS) -> DataFrame:
    """Weight files below root/<project>, told by their first bytes."""
    register(spark)
    return spark.read.format("fleet_weights").option("buckets", buckets).load(root)


def write_files(df: DataFrame, root: str) -> int:
    """Write rows (rel, content binary) as files below a root that all executors reach;
    every task writes its own rows, and a repeated task writes the same again."""
    ship(df.sparkSession)

    def write(batches):
        system, inner = file_system(root)
        for b in batches:
            n = 0
            for rel, content in zip(b.column("rel").to_pylist(), b.column("content").to_pylist()):
                place = f"{inner.rstrip('/')}/{rel}"
                system.create_dir(os.path.dirname(place), recursive=True)
                with system.open_output_stream(place) as f:
                    f.write(content or b"")
                n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return df.select("rel", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
