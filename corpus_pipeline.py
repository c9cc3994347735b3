"""The corpus pipeline, part of subpackage llm: five stages from raw documents to packed sequences.

Every stage works on all that the one before it kept, is written as Parquet and read again. Stages
before the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, ngram_join, packing, suffix_dedup
from quarry.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Dropped rows up to this number (32 MB) are sent to all executors; above it the join shuffles.
BROADCAST_IDS = 2_000_000
#: No stage but the first could be put in SQL that finishes on whole tables, and the last needs a tokenizer.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _without(docs: DataFrame, gone: DataFrame, same) -> DataFrame:
    """``docs`` without those for which there is a row in ``gone``; ``same`` compares the two."""
    gone = materialize(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.alias("d").join((F.broadcast(gone) if few else gone).alias("g"), same, "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go, and those that lie beyond ``langid.unlike_bound`` of this corpus from all learned languages. A null lang becomes the predicted one.

    Without a row to learn from, only the first go, and lang stays. Rows are judged by their text
    alone: a null doc_id and repeated rows are judged as others are. An empty table stays empty.
    """
    docs = _documents(docs)
    model = langid.train(docs)
    told = langid.predict(docs, model, list(COLUMNS), with_distance=True).filter(F.col("distance") <= langid.unlike_bound(docs, model))
    return told.withColumn("lang", F.coalesce("lang", F.when(F.lit(model is not None), F.col("lang_pred")))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest doc_id stays.

    Rows that share a doc_id are one document and stay or go together, repeated rows too. Rows with a
    null doc_id, a null or blank text link with nothing and stay. An empty table stays empty.
    """
    docs = _documents(docs)
    labels = ngram_join.link_components(docs)
    gone = labels.filter("node != component").select(F.col("node").alias("doc_id")).distinct()
    return _without(docs, gone, F.col("d.doc_id") == F.col("g.doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; documents of which nothing is left go, and so do empty ones.

    Rows that share a doc_id are not earlier than one another; rows with a null doc_id stay whole.
    n_chars is counted anew. An empty table stays empty.
    """
    kept = suffix_dedup.remove_repeats(_documents(docs), with_text=True, keep=("lang", "source"))
    text = F.col("kept")
    return kept.filter(F.length(text) > 0).select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a benchmark window go, those with a null doc_id too.

    Rows that share a doc_id are judged each by its own text; repeated rows alike. Null and empty
    texts stay, and so does all where the benchmark is empty. An empty table stays empty.
    """
    docs = _documents(docs)
    gone = decontam.contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_key")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-length sequences; a null text is an empty document, a null doc_id stays null, repeated rows are packed once each."""
    return packing.pack(_documents(docs))


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
