"""Query-adaptive hybrid ranking and maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import sized
from . import lexical, tfidf

#: Product names make a query precise; they are a deployment's own.
PRODUCTS: tuple[str, ...] = ()
#: Weights of cosine, BM25 and quality by kind of query.
WEIGHTS = {"product": (0.75, 0.15, 0.10), "numeric": (0.65, 0.25, 0.10), "long": (0.85, 0.05, 0.10), "plain": (0.80, 0.10, 0.10)}
#: A number with one of these units makes a query numeric, one of these words joins several subjects; the weight of a chosen row's likeness.
QUANTITY = r"\d+\s*(?:ppm|%|°|u/g|mg|g/kg|agu|xylh|amu)"
CONNECTIVES = ["et", "and", "avec", "or", "ou"]
SAME_DOCUMENT, OTHER_DOCUMENT = 1.0, 0.4


def query_kind(text: Column, products: Sequence[str] = PRODUCTS) -> Column:
    q, n = F.lower(text), F.size(T.words(F.lower(text)))
    named = F.lit(False)
    for p in products:
        named |= q.contains(p)
    return F.when(named, "product").when(q.rlike(QUANTITY), "numeric").when(n <= 3, "product").when(n > 8, "long").otherwise("plain")


def query_weights(queries: DataFrame, products: Sequence[str] = PRODUCTS, weights: tuple | None = None) -> DataFrame:
    """Adds w_cosine, w_bm25, w_quality; ``weights`` overrides them for all queries."""
    if weights:
        return queries.withColumns({f"w_{n}": F.lit(float(w)) for n, w in zip(("cosine", "bm25", "quality"), weights, strict=True)})
    kind = query_kind(F.col("text"), products)
    pick = lambda i: F.when(kind == "product", WEIGHTS["product"][i]).when(kind == "numeric", WEIGHTS["numeric"][i]).when(kind == "long", WEIGHTS["long"][i]).otherwise(WEIGHTS["plain"][i])
    return queries.withColumns({"w_cosine": pick(0), "w_bm25": pick(1), "w_quality": pick(2)})


def query_lambda(text: Column, products: Sequence[str] = PRODUCTS) -> Column:
    w = T.words(F.lower(text))
    named = F.lit(False)
    for p in products:
        named |= F.lower(text).contains(p)
    return F.when(named | (F.size(w) <= 3), 0.9).when(F.arrays_overlap(w, F.array(*map(F.lit, CONNECTIVES))), 0.55).when(F.size(w) > 8, 0.6).otherwise(0.7)


def pool_size(k: int) -> int:
    return max(10 * k, 30)


def combine(rows: DataFrame, quality: str = "quality") -> Column:
    """The weighted sum of cosine (from 0 to 1), normalised BM25 and quality, to six decimals."""
    return F.round(F.col("w_cosine") * F.col("cosine") + F.col("w_bm25") * F.col("bm25n") + F.col("w_quality") * F.col(quality), 6)


def hybrid(docs: DataFrame, queries: DataFrame, k: int = 3, weights: tuple | None = None, products: Sequence[str] = PRODUCTS, qkey: str = "item_id", key: str = "doc_id", counts: DataFrame | None = None, bm25: lexical.Fit | None = None) -> DataFrame:
    """(query_id, key, cosine, bm25n, quality, final, rank): the pool of nearest documents by cosine, rescored. Quality is computed for pooled documents only. ``counts`` and ``bm25``: the documents' words (``tfidf.word_counts``) and scores, where they are at hand."""
    cos = tfidf.pool(tfidf.nearest(docs, queries, pool_size(k), qkey=qkey, key=key, counts=counts), queries, docs, pool_size(k), qkey, key).drop("rank")
    pool = sized(cos, "pool")
    bm = (bm25 or lexical.Bm25(docs, key).fit(queries, qkey)).normalised(pool)
    w = query_weights(queries.select(F.col(qkey).alias("query_id"), "text"), products, weights).drop("text")
    pooled = bm.select("query_id", key, "bm25n").join(pool.side(), ["query_id", key], "right")
    wanted = pool.side(pool.table.select(key).distinct())
    quality = docs.join(wanted, key, "left_semi").select(key, T.quality(F.col("text")).alias("quality"))
    rows = pooled.join(pool.side(quality), key).join(pool.side(w), "query_id").withColumns({"cosine": (F.col("cosine") + 1) / 2, "bm25n": F.coalesce("bm25n", F.lit(0.0))})
    rows = rows.withColumn("final", combine(rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), F.desc(F.round("cosine", 9)), key))
    return rows.select("query_id", key, "cosine", "bm25n", "quality", "final", rank.cast("long").alias("rank"))


def mmr_pick(scores: np.ndarray, vectors: np.ndarray, docs: list | None, k: int, lam: float) -> list[int]:
    """Indexes in selection order; scores come in rank order, earlier ranks win ties. With ``docs`` another document's similarity weighs less."""
    if len(scores) <= k:
        return list(range(len(scores)))
    sims = vectors @ vectors.T
    if docs is not None:
        d = np.asarray(docs)
        sims = sims * np.where(d[:, None] == d[None, :], SAME_DOCUMENT, OTHER_DOCUMENT)
    chosen = [int(np.argmax(scores))]
    while len(chosen) < k:
        value = np.round(lam * scores - (1 - lam) * sims[:, chosen].max(1), 9)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
    return chosen


def dense(vectors: list) -> np.ndarray:
    """Rows of numbers, or of {term, w} pairs over the terms that they have, as a matrix."""
    if not any(v and isinstance(v[0], dict) for v in vectors):
        return np.asarray([v if v is not None else [] for v in vectors], np.float64).reshape(len(vectors), -1)
    places: dict = {}
    rows = [[(places.setdefault(p["term"], len(places)), p["w"]) for p in v or ()] for v in vectors]
    out = np.zeros((len(rows), max(1, len(places))))
    for i, row in enumerate(rows):
        for j, w in row:
            out[i, j] = w
    return out


def mmr(candidates: DataFrame, k: int = 3, lam: str = "lambda", key: str = "vec_id", doc: str | None = "label") -> DataFrame:
    """(query_id, key, rank) from (query_id, key, score, rank, vector, lambda and the document column): one query's pool, which ``pool_size`` bounds, is picked at a time. A vector is an array of numbers or of (term, w)."""

    def pick(table: pa.Table) -> pa.Table:
        t = table.sort_by("rank")
        vectors = dense(t["vector"].to_pylist())
        docs = t[doc].to_pylist() if doc else None
        if docs is not None:
            known = {d: i for i, d in enumerate(dict.fromkeys(docs))}
            docs = [known[d] for d in docs]
        got = mmr_pick(np.asarray(t["score"], np.float64), vectors, docs, k, t[lam][0].as_py())
        return pa.table({"query_id": t["query_id"].take(got), key: t[key].take(got), "rank": pa.array(range(1, len(got) + 1), pa.int64())})

    kind = candidates.schema[key].dataType.simpleString()
    return candidates.groupBy("query_id").applyInArrow(pick, f"query_id {candidates.schema['query_id'].dataType.simpleString()}, {key} {kind}, rank long")
