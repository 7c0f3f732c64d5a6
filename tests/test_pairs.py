"""Pairs of features that share no sample have values, too."""

import math

import numpy as np
from helixframe.operators import pairwise as P


def test_pairs_without_a_common_sample(spark):
    x = np.zeros((8, 4))  # samples by features: a and b exclude each other, c meets both, d meets none
    x[:2, 0], x[2:5, 1], x[1:4, 2], x[6, 3] = (1, 3), (2, 5, 1), (4, 1, 2), 7
    names, n = "abcd", len(x)
    rows = spark.createDataFrame([(i, names[j], float(x[i, j])) for i in range(n) for j in range(4) if x[i, j]], "sample int, feature string, value double")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for op, col, want in (
        (P.covariance, "cov", np.cov(x.T)),
        (P.pearson, "cor", np.corrcoef(x.T)),
        (P.cosine_distance, "distance", 1 - np.abs(x.T @ x) / np.outer(*[np.linalg.norm(x, axis=0)] * 2)),
    ):
        got = {(r["f1"], r["f2"]): r[col] for r in op(rows, n).collect()}
        assert set(got) == {(names[i], names[j]) for i, j in pairs}
        assert all(math.isclose(got[names[i], names[j]], want[i, j], abs_tol=1e-12) for i, j in pairs)
    half = rows.filter("sample < 4")  # d is not in it at all; a and b do not meet in it
    both = {(r["f1"], r["f2"]): r for r in P.differential_correlation(rows, n, half, 5).collect()}
    assert set(both) == {(names[i], names[j]) for i, j in pairs}
    assert all((r["z"] is None) == ("d" in k) and r["cor_a"] is not None for k, r in both.items())


def test_ranks_and_distances_with_implicit_zeros(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (30, 5)).astype(float) * (rng.random((30, 5)) < 0.5)
    x[:, 4] = np.arange(30) - 40.0  # no zero at all, and below every other
    names, n = "abcde", len(x)
    rows = spark.createDataFrame([(i, names[j], float(x[i, j])) for i in range(n) for j in range(5) if x[i, j] or (i + j) % 7 == 0], "sample int, feature string, value double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    apart = np.abs(x[:, :, None] - x[:, None, :])
    size = np.abs(x[:, :, None]) + np.abs(x[:, None, :])
    for got, col, want in (
        (P.spearman(rows), "cor", np.corrcoef(np.stack([rank(x[:, j]) for j in range(5)]))),
        (P.spearman(rows, n), "cor", np.corrcoef(np.stack([rank(x[:, j]) for j in range(5)]))),
        (P.minkowski(rows, "euclidean"), "distance", np.sqrt((apart**2).sum(0))),
        (P.minkowski(rows, "manhattan"), "distance", apart.sum(0)),
        (P.minkowski(rows, "canberra"), "distance", np.divide(apart, size, out=np.zeros_like(apart), where=size > 0).sum(0)),
    ):
        found = {(r["f1"], r["f2"]): r[col] for r in got.collect()}
        assert set(found) == {(names[i], names[j]) for i in range(5) for j in range(i + 1, 5)}
        assert all(math.isclose(v, want[names.index(f), names.index(g)], abs_tol=1e-9) for (f, g), v in found.items())


def test_topological_overlap_as_products(spark, monkeypatch):
    a = np.abs(np.corrcoef(np.random.default_rng(3).normal(size=(6, 20))))
    np.fill_diagonal(a, 0)
    k = a.sum(0)
    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(i + 1, 6)], "f1 int, f2 int, cor double")
    for most in (P.GRAM, 2):  # as a product, and as a join
        monkeypatch.setattr(P, "GRAM", most)
        found = {(r["f1"], r["f2"]): r["tom"] for r in P.topological_overlap(rows).collect()}
        assert len(found) == 15
        for (i, j), v in found.items():
            assert math.isclose(v, ((a @ a)[i, j] + a[i, j]) / (min(k[i], k[j]) + 1 - a[i, j]), abs_tol=1e-12)
