"""Vector search: exact, and pruned to the nearest cells of a k-means index that is kept in a folder per cell.

Queries and rows stay tables. Both are packed into blocks, an array of keys and a matrix each; blocks
meet in a join, one matrix product a pair, and a task keeps the best of its rows for each query.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from ..shared import dealt, in_folders, keys_of, shared_path, written

#: Rows and queries of a block; bytes of query blocks that are sent to all executors, above it blocks are joined by shuffle; queries whose best rows a task holds before it passes them on.
ROW_BLOCK, QUERY_BLOCK, MOST_BYTES, HELD = 2048, 1024, 128 << 20, 100_000
#: Rows that one cell holds without an index; probes that are taken where recall isn't measured; rows that a k-means is fitted on per cell, at least FIT_ROWS in all.
FLAT_ROWS, PROBES, FIT_ROWS, FIT_PER_CELL = 100, 10, 100_000, 40
#: Queries that recall is measured with, and the share of true neighbours that they must find.
SAMPLE, RECALL = 64, 0.95


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def _best(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), *keys))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def packed(rows: DataFrame, keys: list[str], vector: str, size: int, name: str, by: str | None = None) -> DataFrame:
    """(by, NAME_keys, NAME_vectors): up to ``size`` neighbouring rows a block, whose ``by`` is the same. Rows without a key or a vector are in none."""
    single = isinstance(rows.schema[vector].dataType.elementType, FloatType)
    known = rows.select(*[F.col(c).cast("long").alias(f"key{i}") for i, c in enumerate(keys)], F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), (F.col(by).cast("long") if by else F.lit(0).cast("long")).alias("by"))
    known = known.filter(" AND ".join(f"key{i} IS NOT NULL" for i in range(len(keys))) + " AND v IS NOT NULL AND by IS NOT NULL")

    def run(batches):
        for batch in batches:
            groups = np.asarray(batch.column(len(keys) + 1))
            edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                for at in range(first, last, size):
                    part = batch.slice(at, min(size, last - at))
                    ids = np.stack([np.asarray(part.column(i)) for i in range(len(keys))], 1)
                    vectors = np.asarray(part.column(len(keys)).flatten())
                    yield pa.record_batch([pa.array([int(groups[at])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["by", f"{name}_keys", f"{name}_vectors"])

    return known.mapInArrow(run, f"by long, {name}_keys binary, {name}_vectors binary")


class Nearest:
    """The best k rows of each query that a task has met."""

    def __init__(self, k: int, n_keys: int):
        self.k, self.place = k, {}
        self.ids = np.empty(0, np.int64)
        self.keys, self.scores = np.empty((0, k, n_keys), np.int64), np.empty((0, k))

    def places(self, ids: np.ndarray) -> np.ndarray:
        new = [i for i in ids.tolist() if i not in self.place]
        if new:
            new = list(dict.fromkeys(new))
            self.place |= {q: len(self.place) + j for j, q in enumerate(new)}
            self.ids = np.concatenate([self.ids, new])
            self.keys = np.concatenate([self.keys, np.full((len(new), *self.keys.shape[1:]), np.iinfo(np.int64).max)])
            self.scores = np.concatenate([self.scores, np.full((len(new), self.k), -np.inf)])
        return np.asarray([self.place[i] for i in ids.tolist()])

    def meet(self, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        """Only rows that can be among the best of a query, the k best of the block and what ties with them, are sorted."""
        at = self.places(ids)
        score = queries @ rows.T
        worst = np.maximum(self.scores[at].min(1), np.partition(score, -self.k, axis=1)[:, -self.k] if score.shape[1] > self.k else -np.inf)
        q, r = np.nonzero(score >= worst[:, None] - 1e-8)
        held = np.repeat(np.arange(len(at)), self.k)
        who = np.concatenate([held, q])
        every, value = np.concatenate([self.keys[at].reshape(-1, keys.shape[1]), keys[r]]), np.concatenate([self.scores[at].ravel(), score[q, r]])
        order = np.lexsort((*every.T[::-1], -np.round(value, 9), who))
        begins = np.searchsorted(who[order], np.arange(len(at)))
        best = order[begins[:, None] + np.arange(self.k)]  # each query has its k of before, so k at least
        self.keys[at], self.scores[at] = every[best], value[best]

    def rows(self, names: list[str]) -> pa.RecordBatch:
        real = self.scores > -np.inf
        keys = self.keys[real]
        return pa.record_batch([pa.array(np.repeat(self.ids, real.sum(1))), *[pa.array(np.ascontiguousarray(keys[:, i])) for i in range(keys.shape[1])], pa.array(self.scores[real])], names=["query_id", *names, "cosine"])


def _product(pairs: DataFrame, k: int, keys: list[str], kinds: tuple[str, str]) -> DataFrame:
    """(query_id, keys, cosine): the k best of each task's rows for each query, from pairs of blocks."""

    def run(batches):
        held = Nearest(k, len(keys))
        for batch in batches:
            for asked, queries, near, rows in zip(*[batch.column(c) for c in ("q_keys", "q_vectors", "r_keys", "r_vectors")], strict=True):
                ids = np.frombuffer(asked.as_buffer(), np.int64)
                those = np.frombuffer(near.as_buffer(), np.int64).reshape(-1, len(keys))
                matrix = lambda b, kind, n: np.frombuffer(b.as_buffer(), kind).reshape(n, -1).astype(np.float64)
                held.meet(ids, matrix(queries, kinds[0], len(ids)), those, matrix(rows, kinds[1], len(those)))
                if len(held.place) > HELD:
                    yield held.rows(keys)
                    held = Nearest(k, len(keys))
        if held.place:
            yield held.rows(keys)

    columns = ", ".join(f"{c} long" for c in keys)
    return pairs.select("q_keys", "q_vectors", "r_keys", "r_vectors").mapInArrow(run, f"query_id long, {columns}, cosine double")


def _kind(rows: DataFrame, vector: str) -> str:
    return "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"


def _blocks(queries: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """Blocks of queries (query_id, vector), as a side of a join: broadcast where they are small."""
    blocks = written(packed(queries, ["query_id"], vector, QUERY_BLOCK, "q", by), "query-blocks")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("q_vectors") + F.octet_length("q_keys")), F.lit(0))).first()[0]
    return F.broadcast(blocks) if size <= MOST_BYTES else blocks


def _asked(queries: DataFrame, key: str, vector: str) -> DataFrame:
    return queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).alias("q"))


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, key: str | Sequence[str] = "vec_id", vector: str = "embedding", query_key: str | None = None) -> DataFrame:
    """(query_id, key, cosine, rank) over all rows, which are read once for any number of queries; k rows per query and task move. ``key`` may be several columns; ties go to the smaller key. Vectors have one width. Rows and queries without a key or a vector are passed over."""
    keys = keys_of(key)
    asked = _asked(queries, query_key or keys[0], vector)
    few = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    blocks = _blocks(asked.repartition(few), "q").drop("by")
    pairs = packed(rows, keys, vector, ROW_BLOCK, "r").join(blocks, F.lit(True))
    return _best(_product(pairs, k, keys, (_kind(asked, "q"), _kind(rows, vector))), k, keys)


def cells(n: int) -> int:
    """Cells for n rows, growing with their root; one cell holds a small table."""
    return 1 if n <= FLAT_ROWS else int(math.sqrt(n))


@dataclass
class IvfIndex:
    """Rows with their cell, and the cells' centroids (cell, centroid). ``probes`` is what a search takes by default."""

    assigned: DataFrame
    centroids: DataFrame
    n_cells: int
    key: str | Sequence[str]
    vector: str
    probes: int

    @property
    def kind(self) -> str:
        return "flat" if self.n_cells == 1 else "ivf"

    def report(self) -> dict:
        return {"index_type": self.kind, "nlist": self.n_cells, "nprobe": self.probes}

    def nearest_cells(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, cell, rank): the ``probes`` cells whose centroids, at length 1, are nearest."""
        unit = self.centroids.select("cell", l2_normalize(F.col("centroid")).alias("q"))
        return cosine_topk(queries, unit, probes, "cell", "q", "query_id").select("query_id", "cell", "rank")

    def tuned(self, sample: DataFrame, k: int, recall: float = RECALL) -> IvfIndex:
        """As many probes as find ``recall`` of the true nearest k of ``sample``, a bounded set of queries; measured against all rows."""
        keys = keys_of(self.key)
        if self.kind == "flat":
            return self
        asked = written(_asked(sample.withColumn("_q", F.monotonically_increasing_id()), "_q", self.vector), "sample")
        truth = cosine_topk(asked.withColumnRenamed("q", self.vector), self.assigned, k, keys, self.vector, "query_id").join(self.assigned.select(*keys, F.col("cell").cast("long").alias("cell")), keys)
        needed = sorted(r["rank"] for r in self.nearest_cells(asked, self.n_cells).join(truth.select("query_id", "cell"), ["query_id", "cell"]).select("rank").collect())  # k a sampled query
        return replace(self, probes=needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if needed else self

    def _probed(self, queries: DataFrame, probes: int | None, query_key: str | None) -> DataFrame:
        asked = written(_asked(queries, query_key or keys_of(self.key)[0], self.vector).filter("query_id IS NOT NULL AND q IS NOT NULL"), "asked")
        near = self.nearest_cells(asked, min(probes or self.probes, self.n_cells))
        return written(near.select("query_id", "cell").join(asked, "query_id"), "probes")

    def _in_cells(self, probed: DataFrame) -> DataFrame:
        return in_folders(self.assigned, "cell", probed, self.n_cells)

    def read_share(self, queries: DataFrame, probes: int | None = None, query_key: str | None = None) -> float:
        """The share of all pairs of a query and a row that a search compares."""
        probed = self._probed(queries, probes, query_key)
        sizes = self.assigned.groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("n"))
        met = probed.join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
        return met / max(1, self.assigned.count() * probed.select("query_id").distinct().count())

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_key: str | None = None) -> DataFrame:
        """(query_id, key, cosine, rank) over the ``probes`` nearest cells of each query. Of a kept index only the folders of cells that some query probes are read, and a cell's blocks meet the queries that probe it, wherever they are read."""
        keys = keys_of(self.key)
        probed = self._probed(queries, probes, query_key)
        blocks = _blocks(probed.repartition("cell").sortWithinPartitions("cell"), "q", "cell")
        rows = packed(self._in_cells(probed), keys, self.vector, ROW_BLOCK, "r", "cell")
        return _best(_product(rows.join(blocks, "by"), k, keys, (_kind(probed, "q"), _kind(self.assigned, self.vector))), k, keys)

    def write(self, path: str) -> IvfIndex:
        """Keeps the index: rows in a folder per cell, centroids beside them."""
        dealt(self.assigned, "cell", f"{path}/rows")
        self.centroids.write.parquet(f"{path}/centroids")
        return replace(self, assigned=self.assigned.sparkSession.read.schema(self.assigned.schema).parquet(f"{path}/rows"), centroids=self.centroids.sparkSession.read.schema(self.centroids.schema).parquet(f"{path}/centroids"))


def open_index(spark: SparkSession, path: str, schema, n_cells: int, key: str | Sequence[str], vector: str, probes: int) -> IvfIndex:
    """A kept index; ``schema`` is that of its rows with their cell."""
    return IvfIndex(spark.read.schema(schema).parquet(f"{path}/rows"), spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids"), n_cells, key, vector, probes)


_CENTROIDS = "cell long, centroid array<double>"


def build_index(rows: DataFrame, key: str | Sequence[str] = "vec_id", vector: str = "embedding", kind: str = "auto", seed: int = 42) -> IvfIndex:
    """An index of ``kind`` flat, ivf or auto (flat for up to FLAT_ROWS rows). The centroids are fitted on a bounded sample, FIT_PER_CELL rows a cell and at least FIT_ROWS, those whose key hashes lowest; every row with a vector is assigned."""
    spark, rows = rows.sparkSession, rows.filter(F.col(vector).isNotNull())
    n = rows.count()
    count = 1 if kind == "flat" or not n else min(n, max(2, cells(n))) if kind == "ivf" else cells(n)
    if count == 1:
        zero = rows.select(F.transform(vector, lambda x: F.lit(0.0)).alias("centroid")).limit(1)
        return IvfIndex(rows.withColumn("cell", F.lit(0)), zero.select(F.lit(0).cast("long").alias("cell"), "centroid"), 1, key, vector, 1)
    vectors = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    most = max(FIT_ROWS, FIT_PER_CELL * count)
    fitted = vectors if n <= most else vectors.orderBy(F.xxhash64(*keys_of(key))).limit(most)
    model = KMeans(k=count, seed=seed, featuresCol="features", predictionCol="cell").fit(fitted)
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], _CENTROIDS)  # the root of the rows
    return IvfIndex(model.transform(vectors).drop("features"), centroids, centroids.count(), key, vector, min(PROBES, count))


def kept_index(rows: DataFrame, key: str | Sequence[str] = "vec_id", vector: str = "embedding", path: str | None = None, k: int = 10, recall: float = RECALL, sample: int = SAMPLE, kind: str = "auto", seed: int = 42) -> IvfIndex:
    """An index that is written to ``path``, with as many probes as find ``recall`` of the true neighbours of ``sample`` rows, those whose key hashes lowest with another seed than the fit's."""
    index = build_index(rows, key, vector, kind, seed).write(path or shared_path(rows.sparkSession, "cells"))
    return index.tuned(index.assigned.orderBy(F.xxhash64(F.lit("recall"), *keys_of(key))).limit(sample).drop("cell"), k, recall)


def ivf_assign(rows: DataFrame, key: str | Sequence[str] = "vec_id", vector: str = "embedding", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows with their cell, centroids)."""
    index = build_index(rows, key, vector, seed=seed)
    return index.assigned, index.centroids


def ivf_topk(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """As ``cosine_topk`` over the nearest cells only, as many as find ``recall`` of the true neighbours of a sample."""
    return kept_index(rows, key, vector, k=k, recall=recall, sample=sample).search(queries, k)
