"""TF-IDF over words and word pairs, sparse cosine, and an optional Gaussian projection."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import Sized, keys_of, sized, written
from . import sparse

FEATURES, BASELINE_FEATURES, DIMENSIONS = 2000, 5000, 384
#: Words that are counted with their ties, a feature.
TIED = 5


def terms(docs: DataFrame, key: str | Sequence[str] = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """(key, term): single words and neighbouring pairs, as often as they stand. Texts without words have no rows."""
    w = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) >= least_chars)
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return docs.select(*keys_of(key), w.alias("w")).filter(F.size("w") > 0).select(*keys_of(key), F.explode(F.concat("w", pairs)).alias("term"))


@dataclass
class Fitted:
    """Documents as rows (key, at, n) of counted terms, with the terms of a vocabulary, their idf and their numbers in the rows, which may have ``size`` numbers, also of other terms."""

    rows: DataFrame
    keys: list[str]
    terms: list[str]
    idf: np.ndarray
    numbers: np.ndarray
    size: int

    def vocabulary(self) -> DataFrame:
        """(term, idf, at) of the terms that stand in a document, with their numbers in the rows."""
        held = [(t, float(i), int(at)) for t, i, at in zip(self.terms, self.idf, self.numbers, strict=True) if i == i]
        kinds = {"term": pa.string(), "idf": pa.float64(), "at": pa.int32()}
        return self.rows.sparkSession.createDataFrame(pa.table({c: pa.array([h[i] for h in held], kind) for i, (c, kind) in enumerate(kinds.items())}))

    def unit(self):
        """The weights of a batch's terms, (1 + ln tf) * idf at length 1 a row; 0 for a term outside of the vocabulary."""
        idf = np.zeros(self.size)
        idf[self.numbers] = self.idf

        def value(at: np.ndarray, n: np.ndarray, row: np.ndarray, batch) -> np.ndarray:
            raw = (1 + np.log(n)) * idf[at]
            norm = np.sqrt(np.bincount(row, raw * raw, batch.num_rows))
            return raw / np.where(norm == 0, 1.0, norm)[row]

        return value

    def _each(self, out, ddl: str) -> DataFrame:
        keys, value, place = self.keys, self.unit(), np.full(self.size, -1)
        place[self.numbers] = np.arange(len(self.terms))

        def run(batches):
            for batch in batches:
                for first in range(0, batch.num_rows, sparse.ROWS):
                    part = batch.slice(first, sparse.ROWS)
                    sizes, at, n = sparse.lists(part, len(keys))
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    w, at = value(at, n, row, part), place[at]
                    if (at < 0).any():
                        row, at, w = (x[at >= 0] for x in (row, at, w))
                        sizes = np.bincount(row, minlength=len(sizes))
                    yield out([part.column(i) for i in range(len(keys))], sizes, row, at, w)

        return self.rows.select(*keys, "at", "n").mapInArrow(run, StructType([*[self.rows.schema[k] for k in keys], *StructType.fromDDL(ddl).fields]))

    def weights(self, digits: int | None = None) -> DataFrame:
        """(key, term, w): unit vectors of (1 + ln tf) * idf, rounded to ``digits`` decimals in their tasks."""
        keys, terms = self.keys, self.terms

        def out(k, sizes, row, at, w):
            w = w if digits is None else sparse.rounded(w, digits)
            return pa.record_batch([*[c.take(pa.array(row)) for c in k], pa.array(terms, pa.string()).take(pa.array(at)), pa.array(w)], names=[*keys, "term", "w"])

        return self._each(out, "term string, w double")

    def vectors(self) -> DataFrame:
        """(key, vector): the weights of a document in order of term; documents without a term have none."""
        keys, terms = self.keys, self.terms
        place = np.argsort(np.argsort(np.array([t.encode() for t in terms], object)))

        def out(k, sizes, row, at, w):
            order = np.lexsort((place[at], row))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()).take(pa.array(at[order])), pa.array(w[order])], names=["term", "w"])
            return pa.record_batch([*k, sparse.arrays(sizes, pairs)], names=[*keys, "vector"])

        return self._each(out, "vector array<struct<term: string, w: double>>").filter(F.size("vector") > 0)

    def norms(self) -> DataFrame:
        """(key, norm): the lengths of the vectors of documents with a term."""
        keys = self.keys
        out = lambda k, sizes, row, at, w: pa.record_batch([*k, pa.array(np.sqrt(np.bincount(row, w * w, len(sizes))))], names=[*keys, "norm"])
        return self._each(out, "norm double").filter("norm > 0")

    def projected(self, dimensions: int = DIMENSIONS) -> DataFrame:
        """(key, embedding): unit vectors of the projected weights of documents with a term; a zero vector stays zero."""
        keys, used = self.keys, sorted(t for t, i in zip(self.terms, self.idf, strict=True) if i == i)
        place = {t: i for i, t in enumerate(used)}
        at_of = np.array([place.get(t, 0) for t in self.terms], np.int64)

        def out(k, sizes, row, at, w):
            matrix = projection(len(used), dimensions)
            found = np.empty((len(sizes), dimensions))
            for first in range(0, len(sizes), 128):
                here = (row >= first) & (row < first + 128)
                dense = np.zeros((min(128, len(sizes) - first), len(used)))
                dense[row[here] - first, at_of[at[here]]] = w[here]
                found[first : first + 128] = dense @ matrix
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            found /= np.where(norm == 0, 1.0, norm)
            some = pa.array(np.flatnonzero(sizes))
            lists = sparse.arrays(np.full(len(sizes), dimensions), pa.array(found.ravel()))
            return pa.record_batch([*[c.take(some) for c in k], lists.take(some)], names=[*keys, "embedding"])

        return self._each(out, "embedding array<double>")

    def scores(self, queries: DataFrame, qkey: str = "item_id", least_chars: int = 1, digits: int = 9) -> tuple[sparse.Scores | None, Sized]:
        """The cosine of queries and documents that share a feature, unless the queries are too many to be sent to all tasks; and the queries' weights."""
        asked = sized(query_weights(queries, self.vocabulary(), qkey, least_chars=least_chars), "query-weights")
        if not asked.few:
            return None, asked
        number = dict(zip(self.terms, self.numbers.tolist(), strict=True))
        rows = [(r.query_id, number[r.term], r.qw) for r in asked.table.collect()]
        return sparse.Scores(self.rows, self.keys, rows, self.size, self.unit(), digits, queries.schema[qkey].dataType), asked


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) of all words of documents, from which several vocabularies can be chosen."""
    return written(sparse.word_counts(docs.select(F.col(text).alias("w")), sparse.Cut(sparse.WORD)), "word-counts")


def _most(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent terms of (term, n)."""
    return df.orderBy(F.desc("n"), "term").limit(n)


def candidates(rows: DataFrame, features: int, cut: sparse.Cut) -> list[str] | None:
    """Terms of the texts ``w`` among which are the ``features`` most frequent, with all ties, or None where that can't be shown.

    Each share of the texts tells its most frequent terms and a bound for all others. The bounds of the shares
    that don't tell a term are what it may have more than is known; ``features`` terms have ``least`` for sure,
    so a term that can't have as many is out, and one that no share tells can't if the sum of all bounds is less.
    """
    told = written(sparse.frequent(rows, cut, TIED * features).groupBy("term").agg(F.sum("n").alias("n"), F.sum("bound").alias("bound")), "frequent-terms")
    known = told.filter("term IS NOT NULL")
    most = (told.filter("term IS NULL").agg(F.sum("bound")).first()[0]) or 0
    if most == 0:  # all terms are told
        return [r.term for r in _most(known, features).collect()]
    often = _most(known, features).collect()  # bounded by the number of features, as are the candidates
    if len(often) < features or most >= often[-1].n:
        return None
    found = known.filter(F.col("n") + most - F.col("bound") >= often[-1].n).select("term").limit(TIED * features + 1).collect()
    return [r.term for r in found] if len(found) <= TIED * features else None


def chosen_of(rows: DataFrame, docs: DataFrame, features: int, key: str | Sequence[str], text: str, least_chars: int, cut: sparse.Cut, counts: DataFrame | None) -> tuple[list[str], list[str]]:
    """The ``features`` most frequent terms, and the words that were counted for them, by whole counts.

    A pair is no more frequent than its words. So words are counted first, and pairs only of words
    that are as frequent as the last of as many words, which no pair of others can reach. Where too many words
    are that frequent, all pairs are counted.
    """
    single = sparse.word_counts(rows, cut) if counts is None else counts.filter(F.length("term") >= least_chars)
    often = _most(single, TIED * features).collect()  # bounded by the number of features
    least = often[features - 1].n if len(often) >= features else 1
    known = [r.term for r in often if r.n >= least]
    if len(often) == TIED * features and often[-1].n >= least:
        best = _most(terms(docs, key, text, least_chars).groupBy("term").agg(F.count("*").alias("n")), features).collect()
        known = sorted({w for r in best for w in r.term.split(" ")})
    else:
        singles = docs.sparkSession.createDataFrame(pa.table({"term": pa.array([r.term for r in often], pa.string()), "n": pa.array([r.n for r in often], pa.int64())}))
        best = _most(singles.unionByName(sparse.word_pairs(rows, known, cut).filter(F.col("n") >= least)), features).collect()
    return [r.term for r in best], known


def fitted(docs: DataFrame, features: int = FEATURES, key: str | Sequence[str] = "doc_id", text: str = "text", least_chars: int = 1, unique: bool = False, counts: DataFrame | None = None, put: Callable[[DataFrame], DataFrame] = lambda rows: written(rows, "term-counts")) -> Fitted:
    """The ``features`` most frequent terms of documents; ties go to the first in order. ``unique``: no two documents share a key. ``counts``: their words, as ``word_counts``. ``put`` writes the rows of counted terms.

    Without ``counts``, texts are read twice: for candidates, of which few are too many, and for their exact counts in each row, which
    also tell the most frequent. Where no proof is found that the most frequent terms are among the candidates, all words are counted.
    """
    keys, cut = keys_of(key), sparse.Cut(sparse.WORD, least_chars)
    texts = docs.select(*keys, F.col(text).alias("w"))
    tried = candidates(texts, features, cut) if counts is None else None
    tried, known = (tried, None) if tried is not None else chosen_of(texts, docs, features, key, text, least_chars, cut, counts)
    rows = sparse.counted(texts, keys, sparse.Vocabulary(tried, True, known), cut)
    rows = put(rows if unique or not sparse.shared_keys(docs, keys) else sparse.merged(rows, keys))
    n_docs = docs.count()
    df, n = sparse.totals(rows, len(tried))
    best = np.array(sorted(range(len(tried)), key=lambda i: (-n[i], tried[i]))[:features], np.int64)
    df = np.where(df > 0, df, np.nan)[best]
    return Fitted(rows, keys, [tried[i] for i in best], np.log((1.0 + n_docs) / (1 + df)) + 1, best, len(tried))


def weights(counted: DataFrame, vocab: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """(key, term, w): unit vectors of (1 + ln tf) * idf."""
    keys = keys_of(key)
    raw = counted.join(F.broadcast(vocab), "term").select(*keys, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))  # bounded by the number of features
    norms = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, keys).select(*keys, "term", (F.col("raw") / F.col("norm")).alias("w"))


def query_weights(queries: DataFrame, vocab: DataFrame, key: str = "item_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    counted = terms(queries, key, text, least_chars).join(F.broadcast(vocab.select("term")), "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    return weights(counted, vocab, key).select(F.col(key).alias("query_id"), "term", F.col("w").alias("qw"))


def matched(weighted: DataFrame, asked: Sized, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """(query_id, key, cosine) of documents that share a feature with a query, to nine decimals, so that equal texts tie."""
    return weighted.join(asked.side(), "term").groupBy("query_id", *keys_of(key)).agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("cosine"))


def nearest(docs: DataFrame, queries: DataFrame, size: int, features: int = FEATURES, least_chars: int = 1, qkey: str = "item_id", key: str | Sequence[str] = "doc_id", digits: int = 9, counts: DataFrame | None = None) -> DataFrame:
    """(query_id, key, cosine) of the ``size`` documents that are nearest to a query and share a feature with it, with the documents' own vocabulary; cosines count by ``digits`` decimals."""
    found = fitted(docs, features, key, least_chars=least_chars, counts=counts)
    scores, asked = found.scores(queries, qkey, least_chars, digits)
    if scores is None:
        return matched(found.weights(), asked, key).withColumn("cosine", F.round("cosine", digits))
    return scores.top(size).select("query_id", *keys_of(key), F.col("score").alias("cosine"))


def pool(found: DataFrame, queries: DataFrame, keys: DataFrame, size: int, qkey: str = "item_id", key: str | Sequence[str] = "doc_id") -> DataFrame:
    """(query_id, key, cosine, rank): the ``size`` best of each query. Documents that share nothing with it have cosine 0 and fill up in order of key; at most ``size`` of them can be asked for."""
    cols = keys_of(key)
    asked = queries.select(F.col(qkey).alias("query_id")).distinct()
    first = F.broadcast(keys.select(*cols).distinct().orderBy(*cols).limit(size))  # a pool's size
    zeros = asked.crossJoin(first).withColumn("cosine", F.lit(0.0))
    rank = lambda: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), *cols))
    best = found.select("query_id", *cols, "cosine").withColumn("rank", rank()).filter(F.col("rank") <= size).drop("rank")
    every = best.unionByName(zeros).groupBy("query_id", *cols).agg(F.max("cosine").alias("cosine"))  # only the best can be in the pool
    return every.withColumn("rank", rank().cast("long")).filter(F.col("rank") <= size)


@functools.lru_cache(2)
def projection(features: int, dimensions: int = DIMENSIONS, seed: int = 42) -> np.ndarray:
    """Gaussian columns of unit length."""
    m = np.random.RandomState(seed).randn(features, dimensions)
    return m / np.linalg.norm(m, axis=0, keepdims=True)
