"""Helpers shared by the training-data operators."""

import ctypes
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexfleet.session import ensure_checkpoint_dir, ship  # noqa: F401

# Texts that one Python step holds at a time, in characters.
STEP_CHARS = 2 << 20


_kept = []


def kept(fn):
    """Keep the last result of `fn` in this process, until another operator claims it."""
    cached = lru_cache(maxsize=1)(fn)
    _kept.append(cached)
    return cached


def claim(*mine):
    """Called first by a Python step: workers are reused, so what other operators keep
    is dropped before this one fills the memory."""
    for cached in _kept:
        if cached not in mine:
            cached.cache_clear()
    release()


def release():
    """Give memory that is free back to the machine; a worker stays when its task ends."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches, rows=1024):
    """Arrow batches in parts of at most `rows`, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def steps(values, limit=STEP_CHARS):
    """Ranges of a list whose texts have about `limit` characters together."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v) if v else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
