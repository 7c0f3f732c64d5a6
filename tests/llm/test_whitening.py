"""Whitening against dense integer and floating-point computations."""

import random
from fractions import Fraction

import numpy as np
import pytest
from helixframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """[(vec_id, x)] of the rows that stay, n, and the exact covariance of the distinct x, as fractions."""
    keep = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(x) for _, x in keep), default=0)
    keep = [(i, x + [1_000_000] * (dims - len(x))) for i, x in keep]
    fit = sorted({tuple(x) for _, x in keep})
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    cov = [[Fraction(n * sum(x[a] * x[b] for x in fit) - sums[a] * sums[b], n * n) for b in range(dims)] for a in range(dims)]
    return keep, fit, n, sums, cov


def check(spark, rows, components=16):
    keep, fit, n, sums, cov = brute(rows)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    got = queries.whitened_rows(*whitening.whitened(df, components=components)).collect()
    dims = len(sums)
    size = min(dims, components)
    assert len(got) == len(keep) * size
    assert {r["n"] for r in got} <= {n}
    want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in keep)
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == [(i, d if d < 2**63 else None) for i, d in want]
    e, w = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    e, w = e[::-1][:size], w[:, ::-1][:, :size].T
    trace = sum(float(cov[k][k]) for k in range(dims))
    real = e > 1e-12 * e.max()
    by = {}
    for r in got:
        by.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["explained"] == pytest.approx(max(e[r["component"] - 1], 0) / trace, rel=1e-6, abs=1e-12)
        assert r["identity_error"] < 1e-4
    for k in range(size):
        mine, theirs = [], []
        for i, x in keep:
            d = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            mine.append(by[str(i), d if d < 2**63 else None][k + 1][0])
            theirs.append(sum(float(Fraction(n * c - s, n)) * u for c, s, u in zip(x, sums, w[k])) / np.sqrt(e[k]) if real[k] else None)
        if real[k]:
            mine, theirs = np.array(mine), np.array(theirs)
            assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-4), k
        else:
            assert mine == theirs
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 20)) @ np.diag(np.linspace(0.2, 2, 20))
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    check(spark, rows + [(1000 + i, x) for i, x in rows[:50]])  # repeats are learned from once


def test_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (104, [0.5, -0.25]), (105, []), (None, rows[0][1]), (7, rows[0][1]), (106, [1e6, 0.0, -1e6, 0.0, 0.0, 3.0])]
    got = check(spark, rows + odd)
    assert not {101, 102, 103, 100} & {r["vec_id"] for r in got} and {104, 105, 106, None} <= {r["vec_id"] for r in got}


def test_few_distinct_vectors(spark):
    got = check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.5]), (3, [1.0, 2.0, 3.0])])
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    got = queries.whitened_rows(*whitening.whitened(one)).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["n"] == 1 for r in got)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert queries.whitened_rows(*whitening.whitened(none)).count() == 0
    only_bad = spark.createDataFrame([(1, None, 0), (2, [None, 1.0], 0)], SCHEMA)
    assert queries.whitened_rows(*whitening.whitened(only_bad)).count() == 0
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], b"x", 3) for i in range(9)], "vec_id long, embedding array<double>, x binary, dims int")
    assert queries.whitened_rows(*whitening.whitened(df)).count() == 18
    texts = spark.createDataFrame([("a", [0.5, 1.0]), ("b", [2.5, -1.0]), ("c", [0.0, 0.0])], "vec_id string, embedding array<float>")
    assert {r["vec_id"] for r in queries.whitened_rows(*whitening.whitened(texts)).collect()} == {"a", "b", "c"}


def test_scatter_without_rounding():
    rng = random.Random(9)
    for bits in (5, 19, 20, 21, 40, 62):
        x = np.array([[rng.randrange(-(2**bits), 2**bits + 1) for _ in range(4)] for _ in range(300)], np.int64)
        own = whitening.Scatter(4)
        own.add(x[:100])
        own.flush()
        own.add(x[100:])
        own.flush()
        exact = x.astype(object)
        assert own.n == 300 and own.sums.tolist() == exact.sum(axis=0).tolist() and own.products.tolist() == (exact.T @ exact).tolist()
        values = [int(v) for v in (exact.T @ exact).reshape(-1)] + [-1, 0, 2**200, -(2**200)]
        assert [whitening.of_limbs(list(v)) for v in zip(*whitening.limbs_of(values))] == values


def test_whole_table(spark):
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got.count() == 16 * len(rows)
    check(spark, rows)
