"""Diffusion maps against dense eigenvectors, pseudotime and fates on a fork."""

import numpy as np
import pytest

from helixframe.operators import graphs, trajectory


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def fork(n=60, seed=1):
    """A stem that parts in two: positions (place along, branch)."""
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, n)
    stem, up, down = np.stack([t, 0 * t], 1), np.stack([1 + t, t], 1), np.stack([1 + t, -t], 1)
    x = np.concatenate([stem, up, down])
    return np.concatenate([x, np.zeros((len(x), 2))], 1) + rng.normal(size=(len(x), 4)) * 0.02, np.concatenate([t, 1 + t, 1 + t])


def test_diffusion_map(spark):
    x, _ = fork()
    knn = graphs.nearest_neighbours(vectors(spark, x), 9).cache()
    k = np.zeros((len(x), len(x)))
    for r in trajectory.adaptive_kernel(knn).collect():
        k[r["src"], r["dst"]] = r["weight"]
    assert np.allclose(k, k.T)
    d = k.sum(1)
    want, basis = np.linalg.eigh(k / np.sqrt(np.outer(d, d)))
    want, basis = want[::-1][:6], basis[:, ::-1][:, :6] / np.sqrt(d)[:, None]
    dc, values, residual = trajectory.diffusion_map(knn, 6)
    assert np.allclose(values, want, atol=1e-6) and residual < 1e-5
    got = np.array([r["dc"] for r in dc.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got, axis=0), 1) and np.ptp(got[:, 0]) < 1e-4
    for j in range(6):
        v = basis[:, j] / np.linalg.norm(basis[:, j])
        assert min(np.abs(got[:, j] - v).max(), np.abs(got[:, j] + v).max()) < 1e-3, j


def test_small_matrices(spark):
    a = np.diag([3.0, 2.0, 1.0]) + 0.1
    rows = [(i, j, float(a[i, j])) for i in range(3) for j in range(3)]
    found, values, _ = trajectory.leading_vectors(spark.createDataFrame(rows, "src long, dst long, weight double"), 5, block=2)
    assert len(values) <= 3 and values[0] == pytest.approx(np.linalg.eigvalsh(a)[-1], abs=1e-6)
    assert len(values) == 3 and found.count() == 3


def test_pseudotime_and_fates(spark):
    x, t = fork()
    knn = graphs.nearest_neighbours(vectors(spark, x), 9).cache()
    got, points = trajectory.palantir(knn, 0, [119, 179], waypoints=30)
    rows = {r["id"]: r for r in got.collect()}
    assert len(rows) == 180 and {0, 119, 179} <= set(points)
    time = np.array([rows[i]["pseudotime"] for i in range(180)])
    rank = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(rank(time), rank(t))[0, 1] > 0.95 and time.min() == 0 and time.max() == 1
    fates = np.array([rows[i]["fates"] for i in range(180)])
    assert fates[100:120, 0].min() > 0.8 and fates[160:180, 1].min() > 0.8
    entropy = np.array([rows[i]["entropy"] for i in range(180)])
    assert entropy[:30].mean() > 0.4 > 0.3 > entropy[105:120].mean()
