"""The local fit behind variable genes: many genes of few distinct means, against the fit of all points."""

import time

import numpy as np
import pytest

from helixframe.operators.cells import _loess, vst_hvg


def _plain(x, y, span, at):
    k = max(3, int(np.ceil(span * len(x))))
    d = np.abs(x - at)
    reach = np.sort(d)[k - 1] or 1e-12
    near = d <= reach
    w = (1 - np.minimum(1, d[near] / reach) ** 3) ** 3 + 1e-12
    return np.linalg.lstsq(np.vander(x[near] - at, 3, increasing=True) * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][0]


def test_fit_of_repeated_and_uneven_points():
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=200), rng.integers(0, 9, size=150) / 7.0, np.repeat([0.0, 1.0, 5.0], [90, 5, 5]), np.sort(rng.exponential(size=64))):
        y = x**2 + rng.normal(size=len(x))
        assert _loess(x, y, 0.3) == pytest.approx([_plain(x, y, 0.3, v) for v in x], rel=1e-6, abs=1e-8)


def test_many_points_of_few_means_take_no_time():
    rng = np.random.default_rng(2)
    x = np.log10(rng.integers(1, 400, size=150_000))
    y = 2 * x + rng.normal(size=len(x))
    began = time.time()
    got = _loess(x, y, 0.3)
    assert time.time() - began < 30
    assert [got[i] for i in (0, 7, 99)] == pytest.approx([_plain(x, y, 0.3, x[i]) for i in (0, 7, 99)], rel=1e-6)


def test_constant_genes_have_no_variance(spark):
    rows = [(c, g, 2 if g == 0 else 1 + (c * g) % 4) for c in range(12) for g in range(5)]
    got = {r.gene: r for r in vst_hvg(spark.createDataFrame(rows, "cell long, gene long, raw long"), 12, 2).collect()}
    assert got[0].variance == 0 and got[0].variance_std == 0 and not got[0].is_hvg and len(got) == 5 and sum(r.is_hvg for r in got.values()) == 2
