"""The search facade: an index that is written once, a plan over it for a batch of queries, and a result cache.

The index is a folder of Parquet tables. What is looked up by term (BM25's postings and idf, TF-IDF
weights) is dealt to folders by the term's hash, what is looked up by chunk (texts, and the forward
vectors that results are compared by) by the chunk's, an encoder's vectors by their cell; a search reads
only folders that it asks for. An index for batches alone has none of what is looked up by term, and its
chunks and vectors stay in the files of the tasks that cut them: a batch reads these in order. The manifest is
written last: with settings, counts, statistics and the tables' schemas. A folder without one is a build
that didn't end, and is never read.
"""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import Future
from dataclasses import replace
from functools import cached_property

import numpy as np
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import chunk, encode, expand, lexical, ranking, tfidf, vector
from .shared import Sized, dealt, in_folders, shared_path, sized, spread
from .sources import loaders

LOG = logging.getLogger(__name__)
TOP_K, MOST_CHARS, CACHE_SIZE = 3, 500, 100
#: Chunks that a folder of the index stands for, and characters that a chunk is counted with for that; folders at most.
FOLDER_CHUNKS, CHUNK_CHARS, MOST_FOLDERS = 200_000, 600, 4096
#: First chunks in order, which fill a pool where too few match.
HEADS = 1000
#: Questions from which on a search reads all chunks in order, and no longer what their terms have in the folders: their words are in most chunks.
MANY = 16
KEY = ["doc_id", "chunk_ord"]
#: How the tables of an index are laid out; one of another layout is built anew.
LAYOUT = 2


class QueryCache:
    """Least recently used results, keyed by every parameter; equal questions at the same time are answered once. Safe to use from many threads."""

    def __init__(self, size: int = CACHE_SIZE):
        self.size, self.held, self.flights, self.lock = size, OrderedDict(), {}, threading.RLock()

    @staticmethod
    def key(query: str, **params) -> str:
        return hashlib.md5(repr((query.lower().strip(), sorted(params.items()))).encode()).hexdigest()

    def get(self, key: str):
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
                return self.held[key]
            return None

    def set(self, key: str, value) -> None:
        with self.lock:
            self.held[key] = value
            self.held.move_to_end(key)
            while len(self.held) > self.size:
                self.held.popitem(last=False)

    def once(self, key: str, make: Callable):
        """(value, whether it was there or on its way already). A failure is told to all who wait, and not kept."""
        with self.lock:
            found = self.get(key)
            if found is not None:
                return found, True
            flight = self.flights.get(key)
            mine = flight is None
            if mine:
                flight = self.flights[key] = Future()
        if not mine:
            return flight.result(), True
        try:
            value = make()
            self.set(key, value)
            flight.set_result(value)
            return value, False
        except BaseException as e:
            flight.set_exception(e)
            raise
        finally:
            with self.lock:
                self.flights.pop(key, None)

    def clear(self) -> None:
        with self.lock:
            self.held.clear()


def chunk_id() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("_chunk"), F.col("chunk_ord").cast("string")).alias("chunk_id")


def _folder(of: str, folders: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(folders)).cast("int").alias("folder")


def _ended(spark: SparkSession, place: str) -> list[str]:
    """Folders below ``place`` with a manifest, the newest first: they are named by time."""
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/*/config/_SUCCESS")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    return sorted((f"{place}/{f.getPath().getParent().getParent().getName()}" for f in found or []), reverse=True)


def cut(docs: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, title, text) with their title and prefix; (doc_id, chunk_ord) is unique.

    Rows that share a doc_id are one document: equal ones count once, and the chunks of others are
    numbered on in the order of their texts' hashes. Rows without a doc_id can't be cited and have none.
    """
    docs = docs.filter("doc_id IS NOT NULL").withColumn("prefix", chunk.prefix("title"))
    again = sized(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    keep = ("title", "prefix")
    if again.table.isEmpty():
        return chunk.chunk(docs, keep=keep)
    once = chunk.chunk(docs.join(again.side(), "doc_id", "left_anti"), keep=keep)
    copies = docs.join(again.side(), "doc_id", "left_semi").dropDuplicates(["doc_id", "title", "text"]).withColumn("copy", F.xxhash64("title", "text"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("copy", "chunk_ord")) - 1
    return once.unionByName(chunk.chunk(copies, keep=(*keep, "copy")).withColumn("chunk_ord", order.cast("long")).drop("copy"))


class Engine:
    """Hybrid search over the chunks of documents (doc_id, text, and a title column), from an index in ``path``."""

    def __init__(self, spark: SparkSession, path: str, encoder: Callable[[], encode.Encoder] | None = None):
        """Opens an index. ``encoder`` is the one that it was built with, if any."""
        self.spark, self.path, self.encoder, self.cache = spark, path, encoder, QueryCache()
        self.config = json.loads(spark.read.text(f"{path}/config", wholetext=True).first().value)
        if encode.identity(encoder) != self.config["encoder"]:
            raise ValueError("an index is searched with the encoder that it was built with")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.config["tables"][name]["schema"])).parquet(f"{self.path}/{name}")

    @staticmethod
    def settings(title: str = "source", contextual: bool = True, features: int = tfidf.FEATURES, encoder: Callable | None = None, inverted: bool = True) -> dict:
        """All that an index depends on but the documents."""
        return {"layout": LAYOUT, "inverted": inverted, "title": title, "contextual": contextual, "features": features, "encoder": encode.identity(encoder), "least": chunk.MIN_WORDS, "most": chunk.MAX_WORDS, "overlap": chunk.OVERLAP, "prefix": chunk.PREFIX_WORDS}

    @staticmethod
    def fingerprint(docs: DataFrame, config: dict) -> str:
        """Of ids, titles, whole texts and all settings."""
        whole = F.concat_ws("\x1f", F.coalesce(F.col(config["title"]).cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
        return loaders.corpus_fingerprint(docs.withColumn("text", whole), json.dumps(config, sort_keys=True)).first().fingerprint

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None, title: str = "source", contextual: bool = True, features: int = tfidf.FEATURES, encoder: Callable[[], encode.Encoder] | None = None, mark: str | None = None, inverted: bool = True) -> Engine:
        """Writes an index of ``docs`` into the new folder ``path``. ``contextual``: what is compared by cosine is a chunk after its document's title and first words. ``mark`` is the fingerprint, where it is known.

        Without ``inverted`` it is an index for batches of questions, which read all chunks in order: the tables that single questions look their terms up in
        (postings, idf, weights) are not written, nothing moves to folders, and a single question is answered as a batch is.
        """
        began, spark, config = time.time(), docs.sparkSession, cls.settings(title, contextual, features, encoder, inverted)
        path, docs = path or shared_path(spark, "index"), spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(title).cast("string").alias(title), "text"))
        tables: dict = {}

        def kept(df: DataFrame, name: str, by: str | None = None, sort: str | None = None) -> DataFrame:
            if by and config["folders"] > 1:
                df = df.withColumn("folder", _folder(by, config["folders"]))
                dealt(df, "folder", f"{path}/{name}", sort or by)
            else:
                df.write.option("compression", "zstd").parquet(f"{path}/{name}")
            out = spark.read.schema(df.schema).parquet(f"{path}/{name}")
            tables[name] = {"schema": out.schema.jsonValue(), "rows": out.count()}
            return out

        size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
        config["folders"] = min(MOST_FOLDERS, size.chars // (FOLDER_CHUNKS * CHUNK_CHARS) + 1) if inverted else 1
        chunks = kept(cut(docs.withColumn("title", F.col(title))).withColumn("chunk_id", chunk_id()), "chunks", "chunk_id")
        kept(chunks.select(*KEY).orderBy(*KEY).limit(HEADS), "heads")
        n = chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.avg("word_count").alias("avg_words"), F.avg("quality_score").alias("avg_quality")).first().asDict()
        config |= n | {"n_docs_loaded": size.n}
        if inverted:
            posted = kept(lexical.row_postings(chunks, KEY), "postings", "term")
            kept(lexical.idf(lexical.doc_freq(posted), spark.range(1).select(F.lit(n["n_chunks"]).alias("n"))), "idf", "term")
        texts = chunks.select(*KEY, "chunk_id", (F.concat_ws(" | ", "prefix", "text") if contextual else F.col("text")).alias("text"))
        if encoder:
            vectors = kept(encode.encode(texts, encoder).select(*KEY, "chunk_id", "vector"), "forward", "chunk_id")
            cells = vector.kept_index(vectors.drop("folder", "chunk_id"), KEY, "vector", f"{path}/cells", ranking.pool_size(TOP_K))
            config["cells"] = {"schema": cells.assigned.schema.jsonValue(), "n_cells": cells.n_cells, "probes": cells.probes}
            shape = vectors.agg(F.avg(F.sqrt(vector.dot(F.col("vector"), F.col("vector")))).alias("mean_norm"), F.max(F.size("vector")).alias("dimensions"))
        else:
            found = tfidf.fitted(texts, features, KEY, unique=True, put=lambda rows: kept(rows.withColumn("chunk_id", chunk_id()), "forward", "chunk_id"))  # a chunk's counted terms
            kept(found.vocabulary(), "vocabulary")
            config["terms"] = found.size
            if inverted:
                kept(found.weights(), "weights", "term")
            shape = found.norms().agg(F.avg("norm").alias("mean_norm"), F.lit(tables["vocabulary"]["rows"]).alias("dimensions"))
        config |= shape.first().asDict() | {"tables": tables, "fingerprint": mark or cls.fingerprint(docs, cls.settings(title, contextual, features, encoder, inverted)), "indexing_time_s": round(time.time() - began, 3)}
        spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.text(f"{path}/config")  # what makes it an index
        return cls(spark, path, encoder)

    def verify(self) -> Engine:
        """Raises where a table can't be read or hasn't the rows that the manifest says."""
        for name, said in self.config["tables"].items():
            found = self._table(name).count()
            if found != said["rows"]:
                raise ValueError(f"{name} has {found} rows instead of {said['rows']}")
        if self.encoder and self._cells().assigned.count() != self.config["n_chunks"]:
            raise ValueError("vectors are missing")
        return self

    @classmethod
    def load(cls, docs: DataFrame, path: str, title: str = "source", contextual: bool = True, features: int = tfidf.FEATURES, encoder: Callable[[], encode.Encoder] | None = None, inverted: bool = True) -> Engine:
        """Opens a saved index; raises ValueError where it was made from other documents, titles or settings."""
        engine = cls(docs.sparkSession, path, encoder)
        if engine.config["fingerprint"] != cls.fingerprint(docs, cls.settings(title, contextual, features, encoder, inverted)):
            raise ValueError(f"the index in {path} was made from other documents or settings")
        return engine

    @classmethod
    def open(cls, docs: DataFrame, path: str, reindex: bool = False, **settings) -> Engine:
        """The newest index of these documents, settings and encoder below ``path`` that is whole, else a new one. Builds that didn't end and damaged ones are passed over and left where they are."""
        spark, mark = docs.sparkSession, cls.fingerprint(docs, cls.settings(**settings))
        place = f"{path.rstrip('/')}/{mark}"
        for found in [] if reindex else _ended(spark, place):
            try:
                return cls(spark, found, settings.get("encoder")).verify()
            except (PySparkException, Py4JError, ValueError, KeyError) as e:
                LOG.warning("the index in %s can't be used and is built anew: %s", found, e)
        return cls.build(docs, f"{place}/{time.time_ns()}-{uuid.uuid4().hex[:8]}", mark=mark, **settings)

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def _wanted(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """The rows of a dealt table in the folders of ``keys``."""
        return in_folders(self._table(name), "folder", keys.select(_folder(key, self.config["folders"])), self.config["folders"])

    def _cells(self) -> vector.IvfIndex:
        c = self.config["cells"]
        return vector.open_index(self.spark, f"{self.path}/cells", StructType.fromJson(c["schema"]), c["n_cells"], KEY, "vector", c["probes"])

    def _many(self, queries: DataFrame) -> bool:
        return not self.config["inverted"] or queries.limit(MANY).count() == MANY

    @cached_property
    def _vocabulary(self) -> list:
        """(term, idf, at), as many as there are features at most."""
        return self._table("vocabulary").orderBy("at").collect()

    def _fitted(self, rows: DataFrame, keys: list[str]) -> tfidf.Fitted:
        """Rows of the forward table with the weights of their terms."""
        held = self._vocabulary
        return tfidf.Fitted(rows, keys, [r.term for r in held], np.array([r.idf for r in held], float), np.array([r["at"] for r in held], np.int64), self.config["terms"])

    def _bm25(self, queries: DataFrame, pool: Sized) -> DataFrame:
        """(query_id, doc_id, chunk_ord, bm25n) of the pool's chunks that have a word of the question."""
        if self._many(queries):
            return lexical.Bm25(self.chunks(), KEY, unique=True).fit(queries).normalised(pool).select("query_id", *KEY, "bm25n")
        words = lexical.query_terms(queries)
        posted, idf = (self._wanted(t, words.table, "term") for t in ("postings", "idf"))
        stats = self.spark.range(1).select(F.lit(self.config["avg_words"]).cast("double").alias("avgdl"))
        return lexical.normalised(lexical.scored(words, posted, idf, stats, KEY)).select("query_id", *KEY, "bm25n")

    def _nearest(self, queries: DataFrame, size: int, exact: bool) -> DataFrame:
        """(query_id, doc_id, chunk_ord, chunk_id, cosine): the pool of each query."""
        if self.encoder:
            asked = encode.encode(queries, self.encoder).select("item_id", "vector")
            cells = self._cells()
            found = vector.cosine_topk(asked, cells.assigned, size, KEY, "vector", "item_id") if exact else cells.search(asked, size, query_key="item_id")
            return found.drop("rank").withColumn("chunk_id", chunk_id())
        heads = self._table("heads") if size <= HEADS else self.chunks()
        if self._many(queries):
            found = self._fitted(self._table("forward"), KEY)
            scores, theirs = found.scores(queries)
            met = scores.top(size).withColumnRenamed("score", "cosine") if scores else tfidf.matched(found.weights(), theirs, KEY)
        else:
            theirs = sized(tfidf.query_weights(queries, self._table("vocabulary")), "query-weights")
            met = tfidf.matched(self._wanted("weights", theirs.table, "term"), theirs, KEY)
        return tfidf.pool(met, queries, heads, size, key=KEY).drop("rank").withColumn("chunk_id", chunk_id())

    def search(self, queries: DataFrame, k: int = TOP_K, use_mmr: bool = True, use_expansion: bool = True, weights: tuple | None = None, rules: expand.Rules = expand.RULES, products: Sequence[str] = ranking.PRODUCTS, exact: bool = False) -> DataFrame:
        """(query_id, rank, doc_id, chunk_id, cosine, bm25, quality, score, explanation) for (item_id, text).

        Cosine takes the query with up to 3 added terms, BM25 with up to 8; weights and the diversity
        parameter follow the query as it was asked. The rank is the order of selection. Only the index
        is read, and of it the folders of the terms and chunks that are asked for; ``k`` 0 means TOP_K.
        With an encoder, the nearest cells are searched, or all vectors with ``exact``. An item_id is
        asked once: where its text isn't the same in all its rows, the smallest counts.
        """
        k = k or TOP_K
        asked = queries.groupBy("item_id").agg(F.min("text").alias("text"))
        far, near = (expand.expand(asked, rules, n).select("item_id", F.col("expanded").alias("text")) if use_expansion else asked for n in (3, 8))
        pool = sized(self._nearest(far, ranking.pool_size(k), exact), "pool")
        bm = self._bm25(near, pool)
        w = ranking.query_weights(asked, products, weights).select(F.col("item_id").alias("query_id"), "w_cosine", "w_bm25", "w_quality", ranking.query_lambda(F.col("text"), products).alias("lambda"))
        rows = bm.join(pool.side(), ["query_id", *KEY], "right").join(pool.side(w), "query_id")
        rows = self._wanted("chunks", pool.table, "chunk_id").select("chunk_id", "quality_score").join(pool.side(rows), "chunk_id").withColumns({"cosine": (F.col("cosine") + 1) / 2, "bm25n": F.coalesce("bm25n", F.lit(0.0))})
        rows = rows.withColumn("score", ranking.combine(rows, "quality_score"))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.round("cosine", 9)), *KEY))
        rows = rows.withColumn("rank", order.cast("long"))
        if use_mmr:
            ranked = sized(rows, "ranked")
            vectors = self._wanted("forward", ranked.table, "chunk_id").join(ranked.side(ranked.table.select("chunk_id").distinct()), "chunk_id", "left_semi")
            vectors = vectors.select("chunk_id", "vector") if self.encoder else self._fitted(vectors, ["chunk_id"]).vectors()
            met = ranked.table.join(vectors, "chunk_id", "left")
            picked = ranking.mmr(met.select("query_id", "chunk_id", "score", "rank", "vector", "lambda", "doc_id"), k, key="chunk_id", doc="doc_id")
            rows = ranked.table.drop("rank").join(picked, ["query_id", "chunk_id"])
        else:
            rows = rows.filter(F.col("rank") <= k)
        said = F.format_string("cosine=%.3f bm25=%.3f quality=%.3f", "cosine", "bm25n", "quality_score")
        return rows.select("query_id", "rank", "doc_id", "chunk_id", F.round("cosine", 4).alias("cosine"), F.round("bm25n", 4).alias("bm25"), F.col("quality_score").alias("quality"), F.round("score", 4).alias("score"), said.alias("explanation"))

    def ask(self, query: str, k: int = TOP_K, use_cache: bool = True, said: Callable[[bool], None] | None = None, **options) -> list:
        """Rows for one question with title and text, through the cache. The question has 1 to 500 characters, k is 1 to 10 or 0 for the default. ``said`` is told whether the answer was there already."""
        query = query.strip()
        if not query or len(query) > MOST_CHARS:
            raise ValueError(f"a question has 1 to {MOST_CHARS} characters")
        if not 0 <= k <= 10:
            raise ValueError("k is 1 to 10")
        key = QueryCache.key(query, k=k or TOP_K, **options)
        found, held = self.cache.once(key, lambda: self._found(query, k, options)) if use_cache else (self._found(query, k, options), False)
        if said:
            said(held)
        return found

    def _found(self, query: str, k: int, options: dict) -> list:
        one = self.spark.createDataFrame([(0, query)], "item_id long, text string")
        best = sized(self.search(one, k, **options), "best")
        return self._wanted("chunks", best.table, "chunk_id").select("chunk_id", "title", "text").join(best.side(), "chunk_id").orderBy("rank").collect()  # k rows

    def response(self, query: str, k: int = TOP_K, **options) -> dict:
        """What a front shows of a question: results, measured time, and whether they come from the cache."""
        began, hits = time.time(), []
        rows = self.ask(query, k, said=hits.append, **options)
        items = [{"rank": r["rank"], "doc_title": r.title, "text": (r.text or "").replace("\n", " ").strip(), "cosine_score": r.cosine, "bm25_score": r.bm25, "final_score": r.score} for r in rows]
        return {"query": query.strip(), "results": items, "search_time_ms": round(1000 * (time.time() - began), 2), "from_cache": hits[0]}

    def stats(self) -> dict:
        """Counts and means of the index as its manifest has them, and how it searches. Fixed interface names."""
        c, cells = self.config, self.config.get("cells")
        index = {"index_type": "inverted"} if not cells else {"index_type": "flat" if cells["n_cells"] == 1 else "ivf", "nlist": cells["n_cells"], "nprobe": cells["probes"]}
        return {
            "n_chunks": c["n_chunks"], "n_docs": c["n_docs"], "avg_quality": round(c["avg_quality"] or 0.0, 3), "avg_words": round(c["avg_words"] or 0.0, 1), "mean_norm": round(c["mean_norm"] or 0.0, 4), "embedding_dim": c["dimensions"] or 0, "vocabulary": c["tables"]["idf"]["rows"] if c["inverted"] else None,
            **index, "model": "encoder" if self.encoder else "TF-IDF", "real_embeddings": bool(self.encoder), "cache_lru_size": len(self.cache.held), "reranking": "cosine + BM25 + quality", "diversification": "MMR", "indexing_time_s": c["indexing_time_s"],
        }


def evaluate_engine(engine: Engine, questions: DataFrame, k: int = TOP_K) -> dict:
    """Hit rates, reciprocal rank, NDCG and mean time of questions (id, query, expected array of doc_ids), asked one by one without the cache; a bounded list."""
    from .operators import evaluate

    rows, took, found = questions.collect(), 0.0, []
    for i, r in enumerate(rows):
        began = time.time()
        found += [(i, int(x.doc_id), int(x["rank"])) for x in engine.ask(r.query, k, use_cache=False)]
        took += 1000 * (time.time() - began)
    spark = engine.spark
    results = spark.createDataFrame(found, "query_id long, doc_id long, rank long")
    relevant = spark.createDataFrame([(i, int(d)) for i, r in enumerate(rows) for d in set(r.expected or [])], "query_id long, doc_id long")
    every = spark.createDataFrame([(i,) for i in range(len(rows))], "query_id long")
    m = evaluate.metrics(evaluate.graded(results, relevant, every)).first().asDict()
    positive = sum(bool(r.expected) for r in rows)
    return m | {"avg_time_ms": round(took / max(len(rows), 1), 2), "n_positive": positive, "n_negative": len(rows) - positive}
