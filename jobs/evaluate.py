"""Measures retrieval pipelines on labelled questions, for comparison before one of them is deployed.

``python -m jobs.evaluate --config jobs/evaluate.json --documents PATH --questions PATH --output FOLDER``

A question's relevant documents are those that hold its passage verbatim. Each pipeline's results are
ranked, marked and measured:

* ``results/pipeline=NAME`` (query_id, rank, doc_id, score, relevant): the best documents of each question;
* ``questions/pipeline=NAME`` (query_id, n_relevant, first, ndcg): each question's grades;
* ``metrics/pipeline=NAME`` (n, hit1, hit3, mrr, ndcg3, composite): the means over all questions.

A run replaces the folders of the pipelines that it was asked for and no others (dynamic partition
overwrite), so running it again gives the same tables, and pipelines can be measured one by one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import evaluate, lexical, passages, ranking, tfidf

from .common import LOG, main

PIPELINES = ("baseline", "bm25", "hybrid")
RESULTS = "query_id long, rank long, doc_id long, score double, relevant boolean, pipeline string"
QUESTIONS = "query_id long, n_relevant long, first long, ndcg double, pipeline string"
METRICS = "n long, hit1 double, hit3 double, mrr double, ndcg3 double, composite double, pipeline string"
SCHEMAS = {"results": RESULTS, "questions": QUESTIONS, "metrics": METRICS}


class Steps:
    """What pipelines of one run have in common, found when the first of them asks for it."""

    def __init__(self, docs: DataFrame, asked: DataFrame):
        self.docs, self.asked = docs, asked

    @functools.cached_property
    def words(self) -> DataFrame:
        return tfidf.word_counts(self.docs)

    @functools.cached_property
    def bm25(self) -> lexical.Fit:
        return lexical.Bm25(self.docs).fit(self.asked)


def ranked(name: str, docs: DataFrame, asked: DataFrame, k: int, steps: Steps | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) of a pipeline: TF-IDF cosine alone, BM25 alone, or both with quality."""
    steps = steps or Steps(docs, asked)
    if name == "baseline":
        cosine = tfidf.nearest(docs, asked, ranking.pool_size(k), tfidf.BASELINE_FEATURES, 2, digits=6, counts=steps.words)
        found = tfidf.pool(cosine, asked, docs, ranking.pool_size(k)).withColumnRenamed("cosine", "score")
    elif name == "bm25":
        found = steps.bm25.rounded(6).top(k).withColumnRenamed("bm25", "score")
    elif name == "hybrid":
        found = ranking.hybrid(docs, asked, k, counts=steps.words, bm25=steps.bm25).withColumnRenamed("final", "score")
    else:
        raise ValueError(f"pipeline {name!r} is none of {', '.join(PIPELINES)}")
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", F.round("score", 4).alias("score"))


def _write(df: DataFrame, config: dict, table: str, name: str) -> DataFrame:
    """Replaces the folder of one pipeline; the rows as they were written."""
    path = f"{config['output'].rstrip('/')}/{table}"
    df.withColumn("pipeline", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pipeline").parquet(path)
    return df.sparkSession.read.schema(SCHEMAS[table]).parquet(path).filter(F.col("pipeline") == name)


def run(spark: SparkSession, config: dict) -> dict:
    """Measures ``pipelines`` over ``documents`` (doc_id, text) and ``questions`` (item_id, text) into ``output``. Rows of documents that share an id count as one document; null texts are found by nothing. Returns each pipeline's means."""
    config = {"pipelines": PIPELINES, "top_k": 3} | config
    docs = spark.read.parquet(config["documents"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = spark.read.parquet(config["questions"]).select("item_id", F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    every = asked.select(F.col("item_id").alias("query_id")).distinct()
    relevant = passages.holding(docs, asked.filter("text != ''"))
    said = {"documents": docs.count(), "questions": every.count(), "relevant": relevant.count()}
    LOG.info("evaluate read %s from %s and %s", said, config["documents"], config["questions"])
    steps = Steps(docs, asked)
    for name in config["pipelines"]:
        marks = relevant.withColumn("relevant", F.lit(True))
        found = ranked(name, docs, asked, config["top_k"], steps).join(marks, ["query_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
        results = _write(found.select("query_id", "rank", "doc_id", "score", "relevant"), config, "results", name)
        grades = evaluate.graded(results, relevant, every, once=True)
        _write(grades.select("query_id", "n_relevant", "first", F.round(evaluate.ndcg(config["top_k"]), 4).alias("ndcg")), config, "questions", name)
        means = evaluate.metrics(grades).withColumn("composite", evaluate.composite())
        said[name] = _write(means, config, "metrics", name).first().asDict()
        LOG.info("evaluate wrote %d results of %s, means %s", results.count(), name, said[name])
    return said


def stored(spark: SparkSession, output: str, table: str = "results") -> DataFrame:
    """The rows of ``results``, ``questions`` or ``metrics`` of all pipelines measured so far."""
    return spark.read.schema(SCHEMAS[table]).parquet(f"{output.rstrip('/')}/{table}")


if __name__ == "__main__":
    main(run, __doc__, ["documents", "questions", "output"])
