"""Sums, minima and ranks over ranges against those over one window."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import ranges as R
from helixframe.functions.ranks import weighted_bh


def test_running_over_ranges(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(rng.integers(0, 9)), float(rng.random()) if i % 5 else None) for i in range(300)], "id int, x int, v double")
    cut = R.ranged(rows, "x", "id", ranges=6)
    assert cut.select("range__").distinct().count() > 2
    one = Window.orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.orderBy(F.desc("x"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    for least, backwards in ((False, False), (True, False), (False, True), (True, True)):
        got = {r["id"]: r["out"] for r in R.running(cut, ["x", "id"], F.col("v"), "out", least, backwards).collect()}
        want = {r["id"]: r["out"] for r in rows.withColumn("out", (F.min if least else F.sum)("v").over(back if backwards else one)).collect()}
        assert set(got) == set(want)
        assert all(a is None and want[i] in (None, 0) or abs((a or 0) - (want[i] or 0)) < 1e-9 for i, a in got.items())


def test_positions_tiles_and_ranks(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(43)], "id int, x int")
    got = {r["id"]: (r["position"], r["t"]) for r in R.positions(rows, "x", "id", ranges=4).withColumn("t", R.tile(F.col("position"), 43, 10)).collect()}
    w = Window.orderBy("x", "id")
    assert got == {r["id"]: (r["p"], r["t"]) for r in rows.select("id", F.row_number().over(w).alias("p"), F.ntile(10).over(w).alias("t")).collect()}
    few = R.positions(rows.limit(3), "id").withColumn("t", R.tile(F.col("position"), 3, 10))
    assert sorted(r["t"] for r in few.collect()) == [1, 2, 3]
    x = np.array([(i * 7) % 5 for i in range(43)])
    ranks = {r["id"]: r["rank"] for r in R.rank_of_all(rows, "x").collect()}
    assert all(ranks[i] == (x < x[i]).sum() + ((x == x[i]).sum() + 1) / 2 for i in range(43))


def test_weighted_adjustment(spark):
    rng = np.random.default_rng(4)
    p, w = rng.random(80).round(2), rng.random(80) + 0.1
    rows = spark.createDataFrame([(i, float(p[i]), float(w[i])) for i in range(80)] + [(80, None, 1.0)], "id int, pvalue double, weight double")
    got = {r["id"]: r["spatial_fdr"] for r in weighted_bh(rows).collect()}
    order = np.lexsort((np.arange(80), p))
    raw = w.sum() * p[order] / np.cumsum(w[order])
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert got[80] is None and all(abs(got[i] - v) < 1e-12 for i, v in zip(order.tolist(), want))
    assert weighted_bh(rows.filter("id > 90")).count() == 0
