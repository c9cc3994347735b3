"""Feeds new documents into the tables that search is built from: cleaned texts, and chunks with their quality.

``python -m jobs.ingest --config jobs/ingest.json --documents FOLDER --output FOLDER --checkpoint FOLDER``

A file stream with a checkpoint takes the files that are new since the last run, all of them and
then ends. Of their rows, only texts are taken that their document doesn't have yet, so a snapshot
that is delivered again costs one thin join. A micro-batch writes into folders of its own, which
it replaces whole when it is run again after a failure, so a rerun gives the same tables:

* ``documents/batch=N/part=P`` (doc_id, title, digest, raw_chars, text): the cleaned text of each document taken;
* ``chunks/batch=N/part=P`` (doc_id, title, digest, chunk_ord, start_pos, end_pos, word_count, quality_score, text).

``part`` is a slug of the column ``collection``, one of few values, so that readers of a collection read
its folders only. A document that changes comes again, in a later batch; ``current`` gives the latest
of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunk
from quarry.shared import BROADCAST_ROWS

from .common import LOG, main, table_or_none

DOCUMENTS = "doc_id long, title string, digest string, raw_chars long, text string, batch long, part string"
CHUNKS = "doc_id long, title string, digest string, chunk_ord long, start_pos long, end_pos long, word_count long, quality_score double, text string, batch long, part string"
KEY = ["doc_id", "digest"]
#: Folders of documents whose collection is null or empty, and of those whose collection has no letter or digit for a slug.
NO_NAME, NO_SLUG = "none", "other"


def _rows(batch: DataFrame, title: str, collection: str) -> DataFrame:
    """Documents as they are read; a null text is the empty one. A collection's slug names its folder, as a folder's name can be neither null nor empty."""
    named = F.coalesce(F.nullif(F.col(collection).cast("string"), F.lit("")), F.lit(NO_NAME))
    slug = F.coalesce(F.nullif(T.slugify(named), F.lit("")), F.lit(NO_SLUG))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(title).cast("string").alias("title"), F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("raw_chars"), text.alias("text"), slug.alias("part"))


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def take(rows: DataFrame, known: DataFrame | None) -> tuple[DataFrame, dict]:
    """``rows`` without texts that their documents have in ``known`` (doc_id, digest), and repeated rows once; with counts of both.

    Keys alone are compared. Whole texts move only where a row is repeated within the batch.
    """
    keys = rows.select(*KEY).persist()
    counts = keys.groupBy(*KEY).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")).first().asDict()
    unchanged = 0
    if known is not None:
        old = keys.distinct().join(known.select(*KEY).distinct(), [keys[k].eqNullSafe(known[k]) for k in KEY], "left_semi")
        unchanged = old.count()
        if unchanged:
            gone = _side(old, unchanged).alias("o")
            rows = rows.alias("r").join(gone, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in KEY], "left_anti")
    if counts["repeated"]:
        rows = rows.dropDuplicates(KEY)
    keys.unpersist()
    return rows, counts | {"unchanged": unchanged}


def write_batch(spark: SparkSession, batch: DataFrame, number: int, config: dict) -> dict:
    """Writes one micro-batch; what it read and wrote."""
    output = config["output"].rstrip("/")
    before = table_or_none(spark, f"{output}/documents", DOCUMENTS)
    known = None if before is None else before.filter(F.col("batch") < number)
    taken, said = take(_rows(batch, config["title"], config["collection"]), known)
    place = {name: f"{output}/{name}/batch={number}" for name in ("documents", "chunks")}
    cleaned = taken.withColumn("text", T.clean(F.col("text")))
    cleaned.write.mode("overwrite").partitionBy("part").parquet(place["documents"])
    held = spark.read.schema(DOCUMENTS).option("basePath", f"{output}/documents").parquet(place["documents"])
    cut = chunk.chunk(held, config["min_words"], config["max_words"], config["overlap"], keep=("title", "digest", "part"))
    cut.write.mode("overwrite").partitionBy("part").parquet(place["chunks"])
    written = spark.read.schema(CHUNKS).option("basePath", f"{output}/chunks").parquet(place["chunks"])
    said |= {"batch": number, "documents": held.count(), "chunks": written.count()}
    LOG.info("ingest %s", said)
    return said


def _glob(path: str) -> str:
    """A pattern that only ``path`` matches. A file stream takes a plain path for a folder, a pattern's match may be one file too."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    return f"{folder}{slash}{{{name}}}" if not set("*?[]{}") & set(path) else path


def run(spark: SparkSession, config: dict) -> dict:
    """Takes what is new in ``documents`` (a folder of Parquet files with doc_id, text, the title and the collection column) into ``output``; ``checkpoint`` remembers what was taken. Returns sums of what was read and written."""
    config = {"title": "source", "collection": "source", "max_files_per_batch": None, "min_words": chunk.MIN_WORDS, "max_words": chunk.MAX_WORDS, "overlap": chunk.OVERLAP} | config
    schema = spark.read.parquet(config["documents"]).schema
    reader = spark.readStream.schema(schema)
    if config["max_files_per_batch"]:
        reader = reader.option("maxFilesPerTrigger", config["max_files_per_batch"])
    done: list[dict] = []
    stream = reader.parquet(_glob(config["documents"])).select("doc_id", "text", *dict.fromkeys([config["title"], config["collection"]]))
    query = stream.writeStream.foreachBatch(lambda df, n: done.append(write_batch(df.sparkSession, df, n, config))).option("checkpointLocation", config["checkpoint"]).trigger(availableNow=True).start()
    query.awaitTermination()
    total = {k: sum(d[k] for d in done) for k in ("read", "repeated", "unchanged", "documents", "chunks")} | {"batches": len(done)}
    LOG.info("ingest of %s into %s: %s", config["documents"], config["output"], total)
    return total


def stored(spark: SparkSession, output: str, name: str) -> DataFrame:
    """All rows of ``documents`` or ``chunks``; none where nothing has been written."""
    schema = {"documents": DOCUMENTS, "chunks": CHUNKS}[name]
    found = table_or_none(spark, f"{output.rstrip('/')}/{name}", schema)
    return spark.createDataFrame([], schema) if found is None else found


def current(spark: SparkSession, output: str, name: str = "chunks") -> DataFrame:
    """The rows of each document's latest batch."""
    latest = stored(spark, output, "documents").groupBy("doc_id").agg(F.max("batch").alias("batch")).alias("l")
    rows = stored(spark, output, name).alias("r")
    return rows.join(latest, F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.batch") == F.col("l.batch")), "left_semi")


if __name__ == "__main__":
    main(run, __doc__, ["documents", "output", "checkpoint"])
