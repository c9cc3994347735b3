"""Binary files through Spark's own writer and reader, so any store that Spark reaches will do.

A text sink writes a string's bytes as they are, followed by a separator. Each row is one chunk of a
file; the separator must be something that the format skips. Tasks commit whole files, so a lost
executor leaves no half-written one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches


def write_blobs(chunks: DataFrame, path: str, separator: str) -> None:
    """Writes the one binary column of ``chunks``, in row order, to a file per partition."""
    with bounded_batches(chunks.sparkSession):
        chunks.select(F.col(chunks.columns[0]).cast("string").alias("value")).write.option("lineSep", separator).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(file_no int, content binary) of the files that ``write_blobs`` left, numbered as the partitions were."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("file_no"), "content")
