"""Retrieval metrics, weight grids and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, MOST_QUALITY = 0.05, 0.30


def weight_grid() -> list[tuple[float, float, float]]:
    """Weights of cosine, BM25 and quality in steps of 0.05: cosine from 0.40, quality at most 0.30."""
    return [(c / 100, b / 100, (100 - c - b) / 100) for c in range(40, 101, 5) for b in range(0, 101 - c, 5) if 100 - c - b <= 30]


def graded(results: DataFrame, relevant: DataFrame, questions: DataFrame, key: str = "doc_id", once: bool = False) -> DataFrame:
    """(query_id, n_relevant, first, gain) for all questions: the rank of the first relevant result, and the discounted gains. A document that several results name gains for each of them, or only for its first with ``once``."""
    if once:
        results = results.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    hits = results.join(relevant, ["query_id", key]).groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return questions.join(sizes, "query_id", "left").join(hits, "query_id", "left").fillna({"n_relevant": 0})


def ndcg(k: int = 3) -> Column:
    """Binary gains over the ideal of min(relevant, k) hits; 1 where nothing is relevant."""
    ideal = sum((F.when(F.col("n_relevant") > i, 1 / F.log2(F.lit(i + 2.0))).otherwise(0.0) for i in range(k)), F.lit(0.0))
    return F.when(F.col("n_relevant") == 0, 1.0).otherwise(F.coalesce("gain", F.lit(0.0)) / ideal)


def metrics(grades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rates and reciprocal rank over all questions; NDCG over those with something relevant."""
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    g = grades.withColumn("ndcg", ndcg())
    return g.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(hit(1), 6).alias("hit1"), F.round(hit(3), 6).alias("hit3"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("n_relevant") > 0, F.col("ndcg"))), 6).alias("ndcg3"))


def deltas(a: dict, b: dict, least: float = 0.001) -> dict:
    """Metric by metric, a - b and whether it is better, worse or equal (within ``least``); of mean times (``avg_time_ms``) the ratio b to a."""
    out: dict = {}
    for name in a.keys() & b.keys() - {"avg_time_ms", "n"}:
        d = a[name] - b[name]
        out[name] = (round(d, 6), "equal" if abs(d) < least else "better" if d > 0 else "worse")
    if "avg_time_ms" in a and "avg_time_ms" in b:
        out["time_ratio"] = b["avg_time_ms"] / max(a["avg_time_ms"], 0.01)
    return out


def composite() -> Column:
    return F.round(0.5 * F.col("mrr") + 0.3 * F.col("hit1") + 0.2 * F.col("hit3"), 4)


def excerpt(text: Column, query: Column, least: int = 20, whole_words: bool = False, most: int = 300, end: str = "...", at_word: bool = False) -> Column:
    """The first sentence with the most query words: words of the sentence that are query words, or with ``whole_words`` False distinct query words that it contains. ``at_word``: what is too long is cut back to its last blank."""
    sents = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    if whole_words:
        score = lambda s, w: F.size(F.filter(F.split(F.lower(s), r"\s+"), lambda x: F.array_contains(w, x)))
    else:
        score = lambda s, w: F.size(F.filter(w, lambda x: F.contains(F.lower(s), x)))
    scored = F.transform(F.array(F.struct(words.alias("w"), sents.alias("s"))), lambda v: F.array_max(F.transform(v["s"], lambda s, i: F.struct(score(s, v["w"]).alias("n"), (-i).alias("i"), s.alias("s")))))
    best = F.coalesce(F.get(scored, F.lit(0))["s"], F.trim(F.replace(text, F.lit("\n"), F.lit(" "))))
    cut = F.left(best, F.lit(most))
    cut = F.regexp_replace(cut, r"(?s) [^ ]*\z", "") if at_word else cut
    return F.when(F.length(best) > most, F.concat(cut, F.lit(end))).otherwise(best)


def score_band(c: Column) -> Column:
    return F.when(c >= 0.70, "green").when(c >= 0.50, "yellow").otherwise("red")
