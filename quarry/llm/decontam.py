"""Benchmark decontamination: which words of a document lie inside an occurrence of a benchmark window.

A prefix-filtered set join. A window's shingles are its word pairs. For containment one necessary
token is enough, so each window is keyed by its rarest pair in the whole corpus (the prefix of length
one in rarity order). Documents probe those keys; a hit at offset o proposes one start, which the
positional and length bounds admit or refuse, and the window's words are compared there exactly.
DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 10
#: Windows up to this number are sent to the executors (some 50 MB); above it the join shuffles.
BROADCAST_WINDOWS = 200_000

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = 0


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and cuts at all other ASCII than 0-9 and a-z. Null has no words."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BREAKS), "")


def item_windows(benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window array<string>, items array<string>): the distinct windows and the items they come from. An item of fewer words, but not none, is one window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter("size(words) > 0 AND item IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    windows = items.withColumn("i", F.explode(starts)).select("item", F.slice("words", F.col("i"), width).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items"))


def _pair(words: str, at: Column) -> Column:
    return F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _single(words: str, at: Column) -> Column:
    return F.xxhash64(F.lit("single"), F.get(words, at))


def _window_tokens(windows: DataFrame) -> DataFrame:
    """(window, items, offset, token): every shingle of every window; a one-word window has its word."""
    many = windows.filter("size(window) > 1").withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("window") - 2)))
    one = windows.filter("size(window) = 1").withColumn("offset", F.lit(0))
    return many.withColumn("token", _pair("window", F.col("offset"))).unionByName(one.withColumn("token", _single("window", F.col("offset"))))


def _exploded(keyed: DataFrame, singles: bool, end: bool) -> DataFrame:
    """(…, words, pos, token): a row per word position; with ``end``, one more per document whose pos is its number of words and whose token is null."""
    words = F.col("words")
    rows = keyed.select("*", F.posexplode(F.concat(words, F.array(F.lit(None).cast("string"))) if end else words).alias("pos", "word"))
    token = F.xxhash64(F.col("word"), F.get("words", F.col("pos") + 1))
    if singles:
        rows = rows.withColumn("token", F.explode(F.when(F.col("word").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(token, F.xxhash64(F.lit("single"), F.col("word"))))))
        return rows.drop("word")
    return rows.select(*keyed.columns, "pos", F.when(F.col("word").isNotNull(), token).alias("token"))


def rarest_keys(keyed: DataFrame, windows: DataFrame, singles: bool, small: bool) -> DataFrame:
    """(token, offset, window, items): each window by its shingle with the fewest occurrences in all documents. Windows with a shingle that occurs nowhere can't occur and go."""
    tokens = _window_tokens(windows)
    wanted = tokens.select("token").distinct()
    counts = _exploded(keyed.select("words"), singles, False).select("token").join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(counts, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("key"), F.first("items").alias("items"))
    return ranked.filter("key.n > 0").select("key.token", "key.offset", "window", "items")


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, pos, start, stop, items): a row per occurrence of a window, and per document a row of its number of words (pos) without start."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    windows = item_windows(benchmark, width)
    n, shortest = windows.agg(F.count("*"), F.min(F.size("window"))).first()
    small, singles = n <= BROADCAST_WINDOWS, shortest == 1
    keys = rarest_keys(keyed, windows, singles, small)
    begin = F.greatest(F.col("pos") - F.col("offset"), F.lit(0))
    fits = (F.col("pos") >= F.col("offset")) & (F.slice("words", begin + 1, F.size("window")) == F.col("window"))
    found = [F.when(F.col("window").isNotNull(), F.col("pos") - F.col("offset")).alias("start"), F.when(F.col("window").isNotNull(), F.col("pos") - F.col("offset") + F.size("window")).alias("stop"), "items"]
    rows = _exploded(keyed, singles, True)
    if small:
        # the end row joins a key of its own, so that one pass gives both hits and lengths
        end = keys.sparkSession.range(1).select(F.lit(None).cast("long").alias("token"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"))
        keys = F.broadcast(keys.unionByName(end).withColumn("token", F.coalesce("token", F.lit(_END).cast("long"))))
        joined = rows.withColumn("token", F.coalesce("token", F.lit(_END).cast("long"))).join(keys, "token")
        return joined.filter(F.col("window").isNull() & (F.col("pos") == F.size("words")) | fits).select("doc_id", "text_key", "pos", *found)
    candidates = rows.filter("token IS NOT NULL").select("doc_id", "text_key", "pos", "token").join(keys, "token").filter("pos >= offset").distinct()
    ends = keyed.select("doc_id", "text_key", F.size("words").alias("pos"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop"), F.lit(None).cast("array<string>").alias("items"))
    again = keyed.distinct()
    hits = candidates.alias("c").join(again.alias("k"), F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.text_key") == F.col("k.text_key"))).select("c.*", "k.words")
    return hits.filter(fits).select("doc_id", "text_key", "pos", *found).unionByName(ends)


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key): the rows that hold a window; text_key is xxhash64 of the text. A null doc_id stays null."""
    return find_windows(docs, benchmark, width, id_col, text_col).filter("start IS NOT NULL").select("doc_id", "text_key").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated.

    Null or empty texts have no words and are clean. Items that are null, empty or have no id give
    no window. A repeated row is reported once each; rows that share a doc_id but not a text are
    judged apart. An empty documents table gives no rows, an empty benchmark no hits. Columns other
    than the two named are not read.
    """
    rows = find_windows(docs, benchmark, width, id_col, text_col)
    spans = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "stop")))
    grouped = rows.groupBy("doc_id", "text_key").agg(
        F.max(F.when(F.col("start").isNull(), F.col("pos"))).cast("long").alias("n_words"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("copies"),
        F.sort_array(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, a.reach))).alias("n"), F.greatest(a.reach, s.stop).alias("reach")),
        lambda a: a.n,
    )
    out = grouped.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "copies")
    return out.withColumn("contaminated", F.col("n_hit") > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")
