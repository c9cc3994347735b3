"""Exact percentiles of groups of any size, by rank selection: no task ever holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Sized, sized

#: Bins of a histogram; values of a group that are sorted at most, more are divided into bins first.
BINS, SORTED = 1024, 5_000


def _wanted(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, n, position, rank, below, low, high) for the one or two ranks between which a percentile lies; at first among all values."""
    return wanted(rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")), by, p)


def wanted(of: DataFrame, by: str, p: float) -> DataFrame:
    """As ``_wanted``, of groups' counts and bounds (by, n, low, high)."""
    of = of.withColumn("position", F.lit(p) * (F.col("n") - 1))
    ranks = F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
    return of.select(by, "n", "position", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "low", "high")


def _narrowed(rows: DataFrame, by: str, value: str, state: DataFrame) -> DataFrame:
    """``state`` with the range of each rank narrowed to the bin that holds it. Bins are counted in every task, and what meets in one are a rank's bins alone."""
    v, half = F.col(value), lambda c: F.col(c) / 2  # of halves, the span is finite
    span = half("high") - half("low")
    place = F.when(span > 0, F.least(F.floor((half(value) - half("low")) / span * BINS), F.lit(BINS - 1))).otherwise(0)
    inside = rows.join(state, by).filter((v >= F.col("low")) & (v <= F.col("high")))
    bins = inside.groupBy(by, "n", "position", "rank", "below", place.alias("bin")).agg(F.count("*").alias("inside"), F.min(value).alias("low"), F.max(value).alias("high"))
    return held(bins, by)


def held(bins: DataFrame, by: str) -> DataFrame:
    """Of counted bins (by, n, position, rank, below, bin, inside, low, high), the one that holds each rank."""
    upto = F.sum("inside").over(Window.partitionBy(by, "rank").orderBy("bin")) + F.col("below")
    counted = bins.withColumn("upto", upto)
    found = counted.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("inside") <= F.col("rank")))
    return found.select(by, "n", "position", "rank", (F.col("upto") - F.col("inside")).alias("below"), "inside", "low", "high")


def percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, n, percentile): the exact, interpolated percentile ``p`` of each group's finite values.

    Of a group with more than SORTED values, a histogram finds the bin of each rank that is wanted,
    again and again until it is small or all its values are equal; only the values in it are sorted,
    equal ones as one. Null, NaN and infinite values aren't counted; a group without a value has no row. ``rows`` is read
    once and once again for each narrowing, so it should be a written table.
    """
    rows = rows.select(by, F.col(value).cast("double").alias(value)).filter((F.col(value) > float("-inf")) & (F.col(value) < float("inf")))
    state = sized(_wanted(rows, by, value, p), "ranks")
    large = lambda t: not t.filter((F.col("inside") > SORTED) & (F.col("low") < F.col("high"))).isEmpty()
    while large(state.table):
        state = sized(_narrowed(rows, by, value, state.side()), "ranks")
    return ended(rows, by, value, state, state.table.filter("low < high"))


def ended(rows: DataFrame, by: str, value: str, state: Sized, open_: DataFrame) -> DataFrame:
    """(by, n, percentile) from ranges that hold few values or one, and the rows in them."""
    v = F.col(value)
    counts = rows.join(state.side(open_), by).filter((v >= F.col("low")) & (v <= F.col("high"))).groupBy(by, "n", "position", "rank", "below", value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(by, "rank").orderBy(value)) + F.col("below")
    sorted_ = counts.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy(by, "n", "position", "rank").agg(F.min(value).alias("at"))
    found = sorted_.unionByName(state.table.filter("low = high").select(by, "n", "position", "rank", F.col("low").alias("at")))
    ends = found.groupBy(by, "n", "position").agg(F.min_by("at", "rank").alias("a"), F.max_by("at", "rank").alias("b"))
    between = (F.ceil("position") - F.col("position")) * F.col("a") + (F.col("position") - F.floor("position")) * F.col("b")
    return ends.select(by, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("percentile"))
