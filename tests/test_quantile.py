import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import quantile


def _groups():
    random.seed(2)
    groups = {1: [5.0], 2: [1.0, 2.0], 3: [7.5] * 400, 4: [0.1] * 300 + [9.0] * 20 + [1e-300, 1e300], 5: [random.random() for _ in range(700)], 6: [10.0 ** random.randint(-12, 12) for _ in range(500)], 7: [None, None], 8: [None, 3.0, -4.0, 0.0], 10: [-1.7e308, 1.7e308, 3.0, float('inf'), float('nan'), 1e308] * 30, 9: [float(i) for i in range(900)] + [899.0] * 600}
    return groups, [(g, x, "clash", 0) for g, v in groups.items() for x in v]


@pytest.mark.parametrize("limits", [(1024, 50_000), (8, 10), (2, 1)])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, monkeypatch, limits, p):
    monkeypatch.setattr(quantile, "BINS", limits[0])
    monkeypatch.setattr(quantile, "SORTED", limits[1])
    groups, rows = _groups()
    table = spark.createDataFrame(rows, "g long, x double, n string, rank int").cache()
    got = {r.g: (r.n, r.percentile) for r in quantile.percentile(table, "g", "x", p).collect()}
    finite = table.filter("x > double('-inf') AND x < double('inf')")
    want = {r.g: r.p for r in finite.groupBy("g").agg(F.percentile("x", p).alias("p")).collect()}
    assert got == {g: (sum(x is not None and abs(x) < float('inf') for x in v), want[g]) for g, v in groups.items() if g != 7}
    assert quantile.percentile(table.filter("false"), "g", "x", p).count() == 0


def test_no_task_holds_a_group(spark):
    """What the last step sorts stays under the limit, whatever the group's size."""
    many = spark.range(3_000_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 1_000_000).cast("double").alias("x"))
    state = quantile.sized(quantile._wanted(many, "g", "x", 0.95), "ranks")
    assert state.table.first().inside > quantile.SORTED
    narrowed = quantile._narrowed(many, "g", "x", state.side())
    assert narrowed.agg(F.max("inside")).first()[0] < quantile.SORTED
    assert quantile.percentile(many, "g", "x", 0.95).first().percentile == many.agg(F.percentile("x", 0.95)).first()[0]
