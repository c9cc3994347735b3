"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: From this number of edges on, nodes with very many are looked after: their least neighbours are broadcast, at most HOT_NODES of them.
MANY_EDGES, HOT_NODES = 1_000_000, 100_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """Adds m, the least of a node u and its neighbours. Degrees are pre-aggregated; a node with more than 2n / HOT_NODES edges is joined by broadcast, so its edges stay where they are."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree"))
    if n < MANY_EDGES:
        return edges.join(least.drop("degree"), "u")
    most = 2 * n // HOT_NODES
    hot = F.broadcast(least.filter(F.col("degree") > most).drop("degree"))  # fewer than HOT_NODES, as all degrees make 2n at most
    rest = edges.join(hot.select("u"), "u", "left_anti").join(least.filter(F.col("degree") <= most).drop("degree"), "u")
    return edges.join(hot, "u").unionByName(rest)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, n).filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    told = _with_least(down, n)
    moved = told.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(told.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches. Nodes without edges aren't listed. Ends when a round changes nothing, which takes about the logarithm of the longest path."""
    state = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = tuple(state.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == mark or not now[0]:
            roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark, before = now, state
        state = materialize(_small_star(_large_star(state, now[0]), now[0]), "edges")
        discard(before)
