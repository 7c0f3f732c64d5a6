"""Operators that SQL cannot express, against plain numeric versions."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import bulk, enrichment, fusion, graphs, harmonise, integration
from helixframe.streaming.quality import collected_windows, windowed_metrics


def vectors(spark, x, at=0):
    return spark.createDataFrame([(at + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def test_page_rank_converges(spark):
    rng = np.random.default_rng(1)
    w = np.where(rng.random((30, 30)) < 0.2, rng.random((30, 30)), 0)
    w[5] = 0  # a node without ways out
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(0, 1.0), (3, 2.0)], "node long, score double")
    p = np.zeros(30)
    p[[0, 3]] = 1 / 3, 2 / 3
    m = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    x = p.copy()
    for _ in range(400):
        x = 0.85 * (x @ m) + (0.15 + 0.85 * x[w.sum(1) == 0].sum()) * p
    got = {int(r[0]): r[1] for r in graphs.personalised_page_rank(edges, seeds).collect()}
    assert max(abs(got.get(i, 0) - x[i]) for i in range(30)) < 1e-7


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 16))[rng.integers(12, size=1500)] * 2 + rng.normal(size=(1500, 16))
    v = vectors(spark, x)
    exact = graphs.nearest_neighbours(v, 10)
    found = graphs.approximate_neighbours(v, 10, probes=12)
    recall = graphs.neighbour_recall(exact, found).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    blocks = graphs.nearest_neighbours(v, 10, blocks=7)
    assert exact.select("id", "neighbour", "rank").exceptAll(blocks.select("id", "neighbour", "rank")).count() == 0


def test_moderated_t(spark):
    rng = np.random.default_rng(3)
    sd = np.sqrt(1 / rng.gamma(4, 1 / 4, 200))
    y = rng.normal(size=(200, 9)) * sd[:, None]
    y[:20, :4] += 3
    groups = spark.createDataFrame([(s, "a" if s < 4 else "b") for s in range(9)], "sample long, grp string")
    values = spark.createDataFrame([(s, g, float(y[g, s]), 1.0) for g in range(200) for s in range(9)], "sample long, gene long, value double, weight double")
    fits = bulk.contrast_fits(bulk.group_fits(values, groups), "a", "b")
    d0, s0 = bulk.variance_prior(fits)
    assert 3 < d0 < 40 and 0.5 < s0 < 1.8
    got = {r["gene"]: r for r in bulk.moderated(fits).collect()}
    for g in range(0, 200, 17):
        a, b = y[g, :4], y[g, 4:]
        s2 = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / 7
        t = (a.mean() - b.mean()) / math.sqrt((d0 * s0 + 7 * s2) / (d0 + 7) * (1 / 4 + 1 / 5))
        assert abs(got[g]["t"] - t) < 1e-9
    p = np.array([got[g]["p"] for g in range(200)])
    assert (p[:20] < 0.05).mean() > 0.8 and (p[20:] < 0.05).mean() < 0.15
    # Known tails of Student's distribution: two degrees have a closed form.
    t = np.array([0.0, 0.5, 2.0, 9.0])
    assert np.allclose(bulk._t_tail(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), atol=2e-6)


def test_harmony_mixes_batches(spark):
    rng = np.random.default_rng(4)
    kind = rng.integers(3, size=600)
    x = rng.normal(size=(3, 8))[kind] * 4 + rng.normal(size=(600, 8)) * 0.5
    batch = rng.integers(2, size=600)
    x[batch == 1] += 1.5
    v = vectors(spark, x)
    b = spark.createDataFrame([(i, int(batch[i])) for i in range(600)], "id long, label int")
    k = spark.createDataFrame([(i, int(kind[i])) for i in range(600)], "id long, label int")
    lisi = lambda t, labels: graphs.inverse_simpson(graphs.nearest_neighbours(t, 15), labels).agg(F.avg("lisi")).first()[0]
    out = harmonise.harmony(v, b, clusters=6).cache()
    assert out.count() == 600
    assert lisi(out, b) > lisi(v, b) + 0.3 and lisi(out, k) < 1.1
    ref = harmonise.build_reference(vectors(spark, x[batch == 0]), 6)
    moved = harmonise.map_query(vectors(spark, x[batch == 1], 1000), ref)
    gap = lambda t: np.abs(np.array([r[0] for r in t.select("embedding").collect()]).mean(0) - x[batch == 0].mean(0)).mean()
    assert gap(moved) < gap(vectors(spark, x[batch == 1], 1000)) / 2


def test_expression_components(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((80, 12)) < 0.5, rng.gamma(2, 1, (80, 12)), 0) * np.linspace(0.5, 3, 12)
    norm = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell long, gene long, norm double")
    genes = spark.createDataFrame([(j,) for j in range(12)], "gene long")
    got = {r[0]: r[1] for r in harmonise.expression_components(norm, genes, 80, 3).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.abs(z @ np.linalg.svd(z, full_matrices=False)[2][:3].T)
    assert max(np.abs(np.abs(got[i]) - want[i]).max() for i in got) < 1e-6


def test_kernel_distribution(spark):
    y = {("a", 1): 1.0, ("b", 1): 2.0, ("c", 1): 4.5, ("a", 2): 3.0, ("b", 2): 3.0, ("c", 2): 0.0}
    expr = spark.createDataFrame([(s, f, v) for (s, f), v in y.items()], "sample string, feature long, value double")
    got = {(r["sample"], r["feature"]): r["d"] for r in enrichment.kernel_distribution(expr).collect()}
    for (s, f), v in y.items():
        own = [w for (_, g), w in y.items() if g == f]
        h = np.std(own, ddof=1) / 4
        assert abs(got[s, f] - np.mean([0.5 * (1 + math.erf((v - w) / h / math.sqrt(2))) for w in own])) < 1e-7
    got = {(r["sample"], r["feature"]): r["d"] for r in enrichment.kernel_distribution(expr, "poisson").collect()}
    for (s, f), v in y.items():
        own = [w + 0.5 for (_, g), w in y.items() if g == f]
        assert abs(got[s, f] - np.mean([sum(math.exp(k * math.log(r) - r - math.lgamma(k + 1)) for k in range(int(v) + 1)) for r in own])) < 1e-7


def test_weighted_neighbours_prefer_the_telling_kind(spark):
    rng = np.random.default_rng(6)
    kind = np.arange(120) % 3
    a, b = vectors(spark, np.eye(3)[kind] * 8 + rng.normal(size=(120, 3)) * 0.3), vectors(spark, rng.normal(size=(120, 3)))
    out = fusion.weighted_neighbours(a, b, graphs.nearest_neighbours(a, 10), graphs.nearest_neighbours(b, 10), 10)
    labels = spark.createDataFrame([(i, int(kind[i])) for i in range(120)], "id long, label int")
    told = {r["id"]: r["label"] for r in integration.transferred_labels(out, labels).collect()}
    assert sum(told[i] == kind[i] for i in range(120)) > 110
    assert out.agg(F.avg("share_first")).first()[0] > 0.5


def test_late_rows_are_dropped(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate(([(day(20), "a", 1.0)], [(day(21), "a", 1.0), (day(20), "a", 2.0)], [(day(2), "a", 5.0), (day(21), "b", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = {(r["window_start"].day, r["event_type"]): (r["n"], r["total"]) for r in collected_windows(windowed_metrics(stream), f"file://{tmp_path}/at").collect()}
    assert got == {(20, "a"): (2, 3.0), (21, "a"): (1, 1.0), (21, "b"): (1, 1.0)}


def test_student_tails_at_many_degrees():
    """Closed forms for one and two degrees, also far out, where a rule on a grid of angles loses digits; the normal limit."""
    t = np.array([0.0, 1e-3, 0.5, 2.0, 40.0, 1e4, 1e7])
    assert np.allclose(bulk._t_tail(t, np.ones(7)), 2 * np.arctan2(1, t) / np.pi, rtol=1e-10)
    assert np.allclose(bulk._t_tail(-t, np.full(7, 2.0)), 2 / (np.sqrt(2 + t * t) * (np.sqrt(2 + t * t) + t)), rtol=1e-10)
    assert np.allclose(bulk._t_tail(t[:4], np.full(4, 9e5)), bulk._t_tail(t[:4], np.full(4, 2e6)), rtol=1e-4)


def test_weights_and_neighbourhoods_read_their_counts_once(spark, tmp_path):
    """What lies behind the counts, joins of whole tables, is not computed again for each sum."""
    rows = [(s, g, float((s * 7 + g * 3) % 11 + g)) for s in range(6) for g in range(20)]
    at = str(tmp_path / "counts")
    spark.createDataFrame(rows, "sample long, gene long, count double").write.parquet(at)
    groups = spark.createDataFrame([(s, s % 2) for s in range(6)], "sample long, grp long")
    read = spark.read.parquet(at)
    v = bulk.voom_weights(read, groups)
    assert v.count() == len(rows) and not any(at in f for f in v.inputFiles())
    near = read.select(bulk.F.col("gene").alias("nhood"), "sample", bulk.F.col("count").alias("n"))
    told = bulk.tested_neighbourhoods(near, groups, 0, 1)
    assert told.count() == 20 and not any(at in f for f in told.inputFiles())
