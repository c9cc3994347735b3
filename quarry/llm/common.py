"""Shared plumbing of the training-data operators: durable intermediate tables and array hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_path

U64 = np.uint64


#: Rows that an Arrow batch of a written step has at most: long texts and sets make batches large, as Spark counts their rows first.
ARROW_ROWS = 1000


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS):
    """Bounds the rows of Arrow batches for what runs inside, unless the session has a bound of its own, and leaves the session as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key, None) is None
    if own:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(key)


def materialize(df: DataFrame, name: str, frees: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage so that a lost executor costs no more than its own tasks. ``frees``: what was shuffled for it is large, and its files go at once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if frees:
        free_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that have ended. It does so once the driver's garbage collector meets their owners, which a driver with much memory may put off until the files of all steps lie side by side."""
    for _ in range(2):  # the second finds what only the first one's finds held
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table._quarry_path
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: What a worker process may hold from task to task: functions that let go of it.
RELEASES: list = []


def trimmed(mapper, holds: bool = False):
    """A mapper that gives free memory back when its task ends; Spark keeps Python workers for later tasks. Unless it ``holds`` what RELEASES lets go of, that goes when its task begins."""

    @functools.wraps(mapper)
    def run(batches):
        if not holds:
            for release in RELEASES:
                release()
        yield from mapper(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches, rows: int = 1024):
    """Arrow batches of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def buckets_for(df: DataFrame, factor: int = 2, least: int = 16) -> int:
    """A bucket count that follows the input: ``factor`` per input partition."""
    return max(least, factor * df.rdd.getNumPartitions())


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers of the public splitmix64 generator), elementwise."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values, by doubling: a run of 2k is a pair of runs of k. ``len(values) - width + 1`` hashes."""
    if len(values) < width:
        return np.empty(0, U64)
    have, hashes = 1, mix(values.astype(U64) + U64(0x9E3779B97F4A7C15))
    out, done, shift = None, 0, 0
    while True:
        if width & have:
            part = hashes[done : done + len(values) - width + 1]
            out = part if out is None else mix(out * U64(0xD6E8FEB86659FD93) + part)
            done += have
        if done == width:
            return out.copy() if out.base is not None else out
        shift = have
        hashes = mix(hashes[:-shift] * U64(0xD6E8FEB86659FD93) + hashes[shift:])
        have *= 2
