"""Session settings and the few helpers that read them."""

import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A side is broadcast only below this estimated size (the optimizer's statistics).
BROADCAST_LIMIT_BYTES = 64 << 20


_shipped = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package once per application, so that functions in
    Python steps find it whatever folder the driver started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="lexfleet-code-"), "lexfleet.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def map_in_pandas(df: DataFrame, fn, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInPandas(fn, schema)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Only where none is named (a
    single-machine test) is a local one made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexfleet-ckpt-"))


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage to the shared checkpoint folder and go on from there: work many
    later steps depend on runs once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a side whose size estimate is under the limit; otherwise leave
    the choice to the optimizer (shuffle join, split by AQE when skewed)."""
    return F.broadcast(df) if estimated_bytes(df) <= BROADCAST_LIMIT_BYTES else df


def grown(df: DataFrame) -> DataFrame:
    """A join side that grows with the facts. The optimizer does not know how many rows
    `explode` and `inline` make; by its estimate it would send such a side through the driver."""
    return df.hint("merge")


def fact_join(facts: DataFrame, other: DataFrame, keys, how="left") -> DataFrame:
    """Join a table with possibly very hot keys to one with few rows per key. The facts
    stand on the left, where adaptive execution can split a hot partition; a small
    other side it broadcasts by its measured size."""
    return facts.join(other, [keys] if isinstance(keys, str) else list(keys), how)


def stepped(df: DataFrame, seed: str, **made) -> DataFrame:
    """Adds columns in a step of their own, and `_one` for `opened`. Large expressions inside one
    whole-stage method are beyond what the JVM compiles; a lambda beside them (`_one`, over the
    column `seed`) keeps the step out of it, so they become small methods."""
    return df.withColumns({**made, "_one": F.transform(F.array(seed), lambda x: x)})


def opened(name: str):
    """The array that `stepped` made, for `inline` and `explode`; never without its `_one`."""
    return F.when(F.size("_one") > 0, F.col(name))


def pinned(df: DataFrame, *columns) -> DataFrame:
    """Rows that several steps read, each another part of the columns. The filter is always true
    and names them all (or `columns`), so no step asks for less and all share the shuffles below;
    what it names is not computed, as its first half holds."""
    return df.filter((F.spark_partition_id() >= 0) | (F.hash(*(columns or df.columns)) == 0))


def local_frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table. Built from Arrow it is a local relation whose size
    the optimizer knows, so `small_side` can check it."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.names]
    arrow = to_arrow_schema(struct)
    table = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=struct)
