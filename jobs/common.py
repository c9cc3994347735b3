"""What both jobs need: their configuration, tables by path, and a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str, given: dict) -> dict:
    """The settings of a JSON file in any store that Spark reads, with what was given on the command line on top."""
    held = json.loads(spark.read.text(path, wholetext=True).first().value)
    return held | {k: v for k, v in given.items() if v is not None}


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table in ``path``, or None where nothing has been written yet. With its schema given, an empty folder is a table too."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return spark.read.schema(schema).parquet(path)


def main(run: Callable[[SparkSession, dict], dict], doc: str, paths: list[str], args: list[str] | None = None) -> dict:
    """Parses a command line, starts a session, runs the job in it and stops it. ``paths`` are options that name a table or a folder."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("--config", required=True, help="JSON file of settings; options override it")
    for p in paths:
        parser.add_argument(f"--{p}", help=f"path of {p}")
    given = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, configured(spark, given.pop("config"), given))
    finally:
        spark.stop()
