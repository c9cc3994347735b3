"""Canonical exact digests: texts that differ only in Unicode form, case or white space agree.

A text is brought to NFKC, lower-cased, and its runs of white space become one space. Two seeds of
the 64-bit xxhash give a 128-bit digest. Inside a bucket of equal digests the canonical texts are
compared byte by byte; should two differ, the later ones in byte order get a number of their own.
DataFrame functions only: the normaliser is the one of the ICU library that Spark brings along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, materialize

#: Repeated digests up to this number are sent to the executors (about 60 MB); above it the join shuffles.
BROADCAST_DIGESTS = 1_000_000
#: Likewise for the order of documents (24 bytes each).
BROADCAST_LINKS = 2_000_000


def canonical(text: Column) -> Column:
    """NFKC, lower case, white space folded and trimmed. Null counts as empty."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text.cast("string"), F.lit("")), F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits in hexadecimal."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")))


def collisions(canons: DataFrame) -> DataFrame:
    """(fingerprint, canon, number) for digests that different canonical texts of ``canons`` (canon, fingerprint) share, numbered from 0 in byte order.

    Only repeated digests are looked at. Their smallest and largest texts are pre-aggregated in
    every task, so a text with very many copies moves once per task.
    """
    repeated = canons.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint")
    repeated = materialize(repeated, "repeated")
    few = repeated.count() <= BROADCAST_DIGESTS
    members = canons.join(F.broadcast(repeated) if few else repeated, "fingerprint", "left_semi")
    spread = members.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).filter("low != high").select("fingerprint")
    texts = members.join(materialize(spread, "collided"), "fingerprint", "left_semi").distinct()
    return texts.withColumn("number", F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1)


def with_fingerprints(rows: DataFrame, canon_cols: dict[str, str], collided: DataFrame | None) -> DataFrame:
    """Adds a fingerprint column for each canonical column; ``collided`` is None where no digest is shared by different texts."""
    for name, canon in canon_cols.items():
        rows = rows.withColumn(name, digest(F.col(canon)))
        if collided is not None:
            other = collided.select(F.col("fingerprint").alias("_f"), F.col("canon").alias("_c"), F.col("number").alias("_n"))
            rows = rows.join(other, (F.col(name) == F.col("_f")) & (F.col(canon) == F.col("_c")), "left")
            rows = rows.withColumn(name, F.when(F.col("_n") > 0, F.concat(name, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_f", "_c", "_n")
    return rows


def collisions_or_none(canons: DataFrame) -> DataFrame | None:
    found = materialize(collisions(canons), "collisions")
    return None if found.isEmpty() else found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; equal canonical texts, and only they, agree. Null is the empty text; repeated rows agree; an empty table gives none."""
    canons = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("canon"))
    found = collisions_or_none(canons.select("canon", digest(F.col("canon")).alias("fingerprint")))
    return with_fingerprints(canons, {"fingerprint": "canon"}, found).select("doc_id", "fingerprint")


def _previous(ids: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, quarter) -> (doc_id, prev_id, prev_quarter) in ascending doc_id order; the last comes before the first.

    Ordered in so many key ranges; only the last row of each range meets the others in one task.
    """
    ranged = materialize(ids.repartitionByRange(ranges, "doc_id").withColumn("range", F.spark_partition_id()), "ranges")
    lasts = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "quarter")).alias("last"))
    order = Window.orderBy("range")
    before = lasts.select("range", F.coalesce(F.lag("last").over(order), F.max("last").over(Window.partitionBy())).alias("before"))
    inside = ranged.withColumn("inside", F.lag(F.struct("doc_id", "quarter")).over(Window.partitionBy("range").orderBy("doc_id")))
    joined = inside.join(F.broadcast(before), "range").withColumn("prev", F.coalesce("inside", "before"))  # a row per range
    return joined.select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.quarter").alias("prev_quarter"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of an edit of it and of the next document.

    The edit replaces the last quarter (in code points, rounded down) by as many of the first of the
    next document in ascending doc_id order, or all it has; after the last comes the first. Likeness
    is 1 for equal fingerprints and else 0, as the digest is exact. Null is the empty text. Where a
    doc_id repeats, each row is reported with the same next document, and the smallest text is the
    one that the previous document takes. Rows with a null doc_id stand outside the order: their
    next document is empty. A table of one document takes itself as the next. No rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    canons = rows.select(canonical(F.col("text")).alias("canon"))
    collided = collisions_or_none(canons.select("canon", digest(F.col("canon")).alias("fingerprint")))
    placed = rows.filter("doc_id IS NOT NULL")
    ids = placed.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("quarter"))
    link = materialize(_previous(ids, buckets_for(placed, 1)), "links")  # ranges follow the input, so each stays as small as its partitions
    few = link.count() <= BROADCAST_LINKS  # then whole texts move once, else twice
    heads = placed.join(F.broadcast(link) if few else link, "doc_id").select(F.col("prev_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("prev_quarter").cast("int")).alias("head"), canonical(F.col("text")).alias("next_canon"))
    heads = with_fingerprints(heads, {"next_fingerprint": "next_canon"}, collided).drop("next_canon")
    heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next_fingerprint")).alias("next")).select("doc_id", "next.*")
    empty = digest(F.lit(""))
    outside = rows.filter("doc_id IS NULL").withColumns({"head": F.lit(""), "next_fingerprint": empty})
    both = placed.join(heads, "doc_id").unionByName(outside)
    quarter = F.floor(F.length("text") / 4).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - quarter)
    edited = both.withColumn("edited", F.concat(kept, F.substring("head", F.lit(1), quarter)))
    both = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), "next_fingerprint")
    both = with_fingerprints(both, {"fingerprint": "canon", "edited_fingerprint": "edited_canon"}, collided)
    same = (F.col("fingerprint") == F.col("edited_fingerprint")) & (F.col("canon") == F.col("edited_canon"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint",
        F.when((F.col("fingerprint") == F.col("edited_fingerprint")) & ~same, F.concat("edited_fingerprint", F.lit("-edited"))).otherwise(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        same.cast("double").alias("near_edited"),
        (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"),
    )
