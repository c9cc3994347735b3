"""BM25 over an inverted table of postings: only matching terms are touched."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import Sized, keys_of, sized, written
from . import quantile, sparse

K1, B = 1.5, 0.75


def tokens(docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(*keys_of(key), F.explode(T.words(F.lower(F.col(text)))).alias("term"))


def term_freq(toks: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    return toks.groupBy(*keys_of(key), "term").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def doc_len(docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(*keys_of(key), F.size(T.words(F.lower(F.col(text)))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of statistics joins every term."""
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def query_terms(queries: DataFrame, qkey: str = "item_id", qtext: str = "text") -> Sized:
    """(query_id, term, qn) as a written table; a repeated word counts repeatedly."""
    return sized(tokens(queries, qkey, qtext).groupBy(F.col(qkey).alias("query_id"), "term").agg(F.count("*").alias("qn")), "query-terms")


def postings(docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, dl): how often a term stands in a document, and that document's length. ``wanted`` (term) restricts them while they are cut."""
    w = T.words(F.lower(F.col(text)))
    keys = keys_of(key)
    rows = docs.select(*keys, w.alias("w")).select(*keys, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    rows = rows if wanted is None else rows.join(wanted, "term", "left_semi")
    return rows.groupBy("term", *keys, "dl").agg(F.count("*").alias("tf")).select("term", *keys, "tf", "dl")


def row_postings(docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text") -> DataFrame:
    """As ``postings`` of documents that share no key: each is counted in its row, and nothing moves."""
    keys = keys_of(key)
    words = docs.select(*keys, T.words(F.lower(F.col(text))).alias("w")).withColumn("dl", F.size("w").cast("long"))
    return sparse.terms_of(words, [*keys, "dl"]).select("term", *keys, "tf", "dl")


def scored(asked: Sized, posted: DataFrame, idfs: DataFrame, stats: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """(query_id, key, bm25) of ``asked`` (query_id, term, qn) over postings, idf per term and one row of avgdl."""
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    terms = asked.side(asked.table.join(idfs.select("term", "idf"), "term"))
    met = posted.join(terms, "term").crossJoin(F.broadcast(stats.select("avgdl")))
    return met.groupBy("query_id", *keys_of(key)).agg(F.round(F.sum(part * F.col("qn")), 9).alias("bm25"))


@dataclass
class Bm25:
    docs: DataFrame
    key: str | Sequence[str] = "doc_id"
    text: str = "text"
    unique: bool = False  # no two documents share a key

    def fit(self, queries: DataFrame, qkey: str = "item_id", qtext: str = "text", digits: int = 9) -> Fit:
        """The scores of queries, to ``digits`` decimals, of documents that share a term; repeated query words count repeatedly. Only postings of query terms are built, in a row per document."""
        asked = query_terms(queries, qkey, qtext)
        if not asked.few:
            posted = postings(self.docs, self.key, self.text, asked.side(asked.table.select("term").distinct()))
            stats = corpus_stats(doc_len(self.docs, self.key, self.text))
            joined = scored(asked, posted, idf(doc_freq(posted), stats), stats, self.key)
            return Fit(keys_of(self.key), None, written(joined.withColumn("bm25", F.round("bm25", digits)), "scores"))
        keys, rows = keys_of(self.key), asked.table.collect()
        terms = sorted({r.term for r in rows})
        texts = self.docs.select(*keys, F.col(self.text).alias("w"))
        counts = written(sparse.counted(texts, keys, sparse.Vocabulary(terms), sparse.Cut(sparse.UNBLANK), "dl"), "postings")
        n, avgdl = counts.agg(F.count("*"), F.avg("dl")).first()
        again = not self.unique and sparse.shared_keys(counts, keys)
        counts = written(sparse.merged(counts, [*keys, "dl"]), "postings") if again else counts
        df = sparse.held_by(counts, len(terms))
        idfs, place = np.log((n - df + 0.5) / (df + 0.5) + 1), {t: i for i, t in enumerate(terms)}

        def value(at: np.ndarray, tf: np.ndarray, row: np.ndarray, batch) -> np.ndarray:
            dl = np.asarray(batch.column(batch.schema.names.index("dl")).fill_null(0))[row]
            return idfs[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

        if again:  # a document's rows of different lengths add up
            counts, value = written(sparse.valued(counts, keys, value), "values"), lambda at, v, row, batch: v
        return Fit(keys, sparse.Scores(counts, keys, [(r.query_id, place[r.term], r.qn) for r in rows], len(terms), value, digits, queries.schema[qkey].dataType), None)

    def scores(self, queries: DataFrame, qkey: str = "item_id", qtext: str = "text") -> DataFrame:
        """(query_id, key, bm25) of all documents that share a term."""
        return self.fit(queries, qkey, qtext).pairs()


@dataclass
class Fit:
    """BM25 of documents for queries: by rows of postings, or as a table of pairs where the queries are too many to be sent to all tasks."""

    keys: list[str]
    scores: sparse.Scores | None
    joined: DataFrame | None

    def rounded(self, digits: int) -> Fit:
        """The same scores to fewer decimals."""
        if self.scores:
            scores = copy.copy(self.scores)
            scores.rows, scores.digits = self.scores.rows, digits
            return Fit(self.keys, scores, None)
        return Fit(self.keys, None, self.joined.withColumn("bm25", F.round("bm25", digits)))

    def pairs(self) -> DataFrame:
        """(query_id, key, bm25)."""
        return self._named(self.scores.pairs()) if self.scores else self.joined

    def _named(self, found: DataFrame) -> DataFrame:
        return found.withColumnRenamed("score", "bm25")

    def top(self, k: int) -> DataFrame:
        """(query_id, key, bm25, rank) of the ``k`` best documents of each query."""
        return self._named(self.scores.top(k)) if self.scores else top(self.joined, k, "bm25", self.keys)

    def of(self, pool: Sized) -> DataFrame:
        """(query_id, key, bm25) of the pairs in a pool (query_id, key) that score."""
        if self.scores:
            return self._named(self.scores.of(pool.table, pool.side))
        return self.joined.join(pool.side(pool.table.select("query_id", *self.keys)), ["query_id", *self.keys], "left_semi")

    def p95(self) -> DataFrame:
        """(query_id, p95), as ``p95``."""
        return self.scores.percentile(0.95).select("query_id", F.col("percentile").alias("p95")) if self.scores else p95(self.joined)

    def normalised(self, pool: Sized | None = None) -> DataFrame:
        """As ``normalised``, of all pairs or of those in a pool."""
        return _clipped(self.of(pool) if pool else self.pairs(), sized(self.p95(), "p95"))

    def shares(self, digits: int) -> DataFrame:
        """(query_id, key, bm25n) of all pairs, to ``digits`` decimals; where the queries are few, divided and rounded in the tasks that score."""
        if self.scores:
            return self.scores.shares(0.95, digits).withColumnRenamed("score", "bm25n")
        return self.normalised().select("query_id", *self.keys, F.round("bm25n", digits).alias("bm25n"))


def top(scores: DataFrame, k: int, score: str, key: str | Sequence[str] = "doc_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), *keys_of(key)))
    return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def p95(scores: DataFrame) -> DataFrame:
    """(query_id, p95): the 95th percentile of each query's positive scores, exact, without a task that holds a query's scores."""
    return quantile.percentile(scores.filter("bm25 > 0"), "query_id", "bm25", 0.95).select("query_id", F.col("percentile").alias("p95"))


def normalised(scores: DataFrame) -> DataFrame:
    """Adds bm25n: one positive score is divided by itself, several by their 95th percentile, clipped to 0 and 1."""
    scores = written(scores, "scores")
    return _clipped(scores, sized(p95(scores), "p95"))


def _clipped(scores: DataFrame, positive: Sized) -> DataFrame:
    return scores.join(positive.side(), "query_id", "left").withColumn("bm25n", F.when(F.col("p95").isNull(), F.col("bm25")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bm25") / F.col("p95")))))
