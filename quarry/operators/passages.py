"""Documents that hold a passage verbatim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import Sized, sized, written
from . import sparse

#: Passages of fewer words than this have none that stands between blanks; they are looked for in every document, so many in one step.
LEAST_WORDS, BLOCK = 3, 256


def _inner(words: Column) -> Column:
    """Words with another one before and behind: wherever the passage stands, blanks are around them."""
    return F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))


def holding(docs: DataFrame, passages: DataFrame, key: str = "doc_id", qkey: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, key), once each: documents whose text contains a passage's.

    Texts are searched for a passage where they have the rarest of its inner words. A first reading
    counts the texts that have each inner word, in their tasks; a second cuts each text again and
    searches it where it is met, so nothing but what is found moves. Short passages meet every
    document in blocks, a stated query set. Null passages and texts hold nothing; an empty passage
    stands in every text. Passages with too many words to be sent to all tasks meet their documents by joins.
    """
    items = passages.select(F.col(qkey).alias("query_id"), F.col(text).alias("passage")).filter("passage IS NOT NULL")
    w = T.words(F.col("passage"))
    long = items.filter(F.size(w) >= LEAST_WORDS)
    wanted = sized(long.select("query_id", "passage", F.explode(_inner(w)).alias("word")), "passage-words")
    texts = docs.select(key, F.col(text).alias("held"))
    found = (_searched if wanted.few else _joined)(docs, wanted, key, text)
    short = sized(items.filter(F.size(w) < LEAST_WORDS), "short")
    n = short.table.count()
    if n:
        blocks = short.table.groupBy(F.pmod(F.xxhash64("query_id", "passage"), F.lit(n // BLOCK + 1)).alias("b")).agg(F.collect_list(F.struct("query_id", "passage")).alias("block"))
        every = texts.join(F.broadcast(blocks) if short.few else blocks, F.lit(True))
        found = found.unionByName(every.select(key, "held", F.explode("block").alias("p")).filter(F.contains("held", "p.passage")).select("p.query_id", key))
    return written(found.distinct(), "holding")


def _searched(docs: DataFrame, wanted: Sized, key: str, text: str) -> DataFrame:
    words = sorted(r[0] for r in wanted.table.select("word").distinct().collect())
    cut, rows = sparse.Cut(sparse.UNBLANK, lower=False), docs.select(key, F.col(text).alias("w")).filter(F.col(key).isNotNull())
    often = {words[r["at"]]: r["n"] for r in sparse.rows_with(rows, words, cut).collect()}  # one per word of a passage
    rarest: dict = {}
    for r in wanted.table.collect():
        rarest.setdefault((r.query_id, r.passage), []).append((often.get(r.word, 0), r.word))
    asked = [(q, passage, min(of)[1]) for (q, passage), of in rarest.items() if min(of)[0]]
    id_type = wanted.table.schema["query_id"].dataType
    return sparse.holders(rows, key, asked, cut, id_type)


def _joined(docs: DataFrame, wanted: Sized, key: str, text: str) -> DataFrame:
    words = docs.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("word"))
    often = words.join(wanted.table.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = wanted.table.join(often, "word").groupBy("query_id", "passage").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = words.join(rarest, "word").select("query_id", "passage", key)
    return docs.select(key, F.col(text).alias("held")).join(met, key).filter(F.contains("held", "passage")).select("query_id", key)
