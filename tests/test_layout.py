"""Fuzzy graphs against numpy, the curve's published values, and layouts that keep neighbours and clusters."""

import numpy as np
import pytest

from helixframe.operators import graphs, layout


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def clusters(n=40, k=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, 8)) * 8
    return np.concatenate([c + rng.normal(size=(n, 8)) for c in centres]), np.repeat(np.arange(k), n)


def test_curve():
    a, b = layout.curve(1.0, 0.1)  # the values that the method's authors give for these settings
    assert a == pytest.approx(1.577, abs=2e-3) and b == pytest.approx(0.895, abs=2e-3)


def test_fuzzy_graph(spark):
    x, _ = clusters(12, 2)
    x[1] = x[0]  # a distance of zero
    k = 5
    knn = graphs.nearest_neighbours(vectors(spark, x), k)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = np.zeros((len(x), len(x)))
    for r in knn.collect():
        want[r["id"], r["neighbour"]] = -1
    for i in range(len(x)):
        on = want[i] < 0
        near, low, high = d[i][on][d[i][on] > 0].min(), 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-np.maximum(d[i][on] - near, 0) / mid).sum() > np.log2(k + 1) else (mid, high)
        want[i, on] = np.exp(-np.maximum(d[i][on] - near, 0) / max(mid, d[i][on].mean() * 1e-3))
    want = want + want.T - want * want.T
    got = np.zeros_like(want)
    for r in layout.fuzzy_graph(knn).collect():
        got[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(got, want, atol=1e-6) and np.allclose(got, got.T) and got.max() <= 1 + 1e-9


def test_equal_distances_and_no_rows(spark):
    rows = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3) if i != j], "id long, neighbour long, distance double")
    assert {round(r["weight"], 9) for r in layout.fuzzy_graph(rows).collect()} == {1.0}
    none = spark.createDataFrame([], "id long, neighbour long, distance double")
    assert layout.fuzzy_graph(none).count() == 0
    start = spark.createDataFrame([], "id long, at array<double>")
    assert layout.umap(layout.fuzzy_graph(none), start).count() == 0


@pytest.mark.parametrize("block_rows", [10_000, 50])  # one block, and several that differ from round to round
def test_neighbours_and_clusters_stay(spark, block_rows):
    x, label = clusters()
    v = vectors(spark, x)
    g = layout.fuzzy_graph(graphs.nearest_neighbours(v, 12)).cache()
    start = layout.spectral_start(g, 2, tolerance=1e-2, most=3)
    rows = layout.umap(g, start, block_rows=block_rows).orderBy("id").collect()
    y = np.array([r["at"] for r in rows])
    assert [r["id"] for r in rows] == list(range(len(x))) and np.isfinite(y).all()
    d = np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :8]
    assert (label[near] == label[:, None]).mean() > 0.98
    near = spark.createDataFrame([(i, int(j)) for i in range(len(x)) for j in near[i]], "id long, neighbour long")
    ranks = graphs.nearest_neighbours(v, len(x) - 1)
    assert layout.trustworthiness(near, ranks, len(x), 8) > 0.93


def test_rows_without_edges_stay_and_reruns_agree(spark):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 9, 1.0)], "src long, dst long, weight double")
    start = spark.createDataFrame([(i, [float(i * 5), 0.0]) for i in range(4)], "id long, at array<double>")
    one, two = ({r["id"]: list(r["at"]) for r in layout.umap(g, start, epochs=20, rounds=2).collect()} for _ in range(2))
    assert one == two and one[2] == [10.0, 0.0] and one[3] == [15.0, 0.0]
    assert abs(one[0][0] - one[1][0]) < 5
