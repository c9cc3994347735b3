"""Tables that a plan writes between its steps, and joins whose broadcast side has a known size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table up to this number of rows is sent to all executors; above it the join shuffles.
BROADCAST_ROWS = 200_000


def keys_of(key: str | Sequence[str]) -> list[str]:
    """The columns of a key that is one column or several."""
    return [key] if isinstance(key, str) else list(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset and all runs in one process (tests), a new temporary one, which then is set; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """An input that comes in fewer splits than there are cores, as a small file does, dealt out to all of them; a larger one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Sized:
    """A written table that grows with the queries, not with the corpus."""

    table: DataFrame
    few: bool

    def side(self, df: DataFrame | None = None) -> DataFrame:
        """The table, or ``df`` that has no more rows than it, as a side of a join: broadcast where it is small."""
        df = self.table if df is None else df
        return F.broadcast(df) if self.few else df


def sized(df: DataFrame, name: str) -> Sized:
    table = written(df, name)
    return Sized(table, table.count() <= BROADCAST_ROWS)


def dealt(df: DataFrame, column: str, path: str, sort: str | None = None) -> None:
    """Writes ``df`` in a folder per value of ``column``. Rows of a folder come together, but a large folder's rows are split over tasks, so that one value with a large share of the rows holds up no task. ``sort`` orders a file's rows."""
    together = df.hint("rebalance", F.col(column))
    (together.sortWithinPartitions(column, sort) if sort else together).write.option("compression", "zstd").partitionBy(column).parquet(path)


def in_folders(table: DataFrame, column: str, wanted: DataFrame, most: int) -> DataFrame:
    """The rows of a dealt table in the folders that ``wanted`` names, of ``most`` that there are: the few numbers become a partition filter of the scan."""
    if most == 1:
        return table
    return table.filter(F.col(column).isin([r[0] for r in wanted.select(column).distinct().limit(most).collect()]))
