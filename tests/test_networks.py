"""Importances of factors: planted regulation, blocks, stopping."""

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import networks


def planted(n=600, seed=1):
    rng = np.random.default_rng(seed)
    f = rng.poisson(2.0, (n, 8)).astype(float)
    noise = rng.normal(size=(n, 4)) * 0.5
    y = np.stack([3 * f[:, 0] - 2 * f[:, 3], f[:, 1] ** 2, np.abs(f[:, 5] - 3) * f[:, 6], 0 * f[:, 0]], axis=1) + noise
    y = y - y.min() + 1
    return f, y


def frame(spark, f, y):
    rows = [(c, f"tf{j}", float(f[c, j])) for c in range(len(f)) for j in range(f.shape[1]) if f[c, j]] + [(c, f"g{j}", float(y[c, j])) for c in range(len(y)) for j in range(y.shape[1])]
    return spark.createDataFrame(rows, "cell long, gene string, value double"), spark.createDataFrame([(f"tf{j}",) for j in range(f.shape[1])] + [("absent",)], "tf string")


def shares(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["gene"], {})[r["tf"]] = r["importance"]
    return out


def test_planted_factors(spark, monkeypatch):
    f, y = planted(1500)
    expr, tf = frame(spark, f, y)
    one = shares(networks.factor_importances(expr, tf, features=0.6))
    top = lambda d, k: set(sorted(d, key=d.get)[-k:])
    assert top(one["g0"], 2) == {"tf0", "tf3"} and one["g0"]["tf0"] > one["g0"]["tf3"] > 0.1
    assert top(one["g1"], 1) == {"tf1"} and one["g1"]["tf1"] > 0.9
    assert top(one["g2"], 2) == {"tf5", "tf6"}
    assert all(abs(sum(d.values()) - 1) < 1e-9 for d in one.values()) and all("tf0" not in d for g, d in one.items() if g == "tf0")
    assert one == shares(networks.factor_importances(expr.repartition(7), tf, features=0.6))
    monkeypatch.setattr(networks, "BLOCK_CELLS", 300)
    monkeypatch.setattr(networks, "TASK_TARGETS", 3)
    many = shares(networks.factor_importances(expr, tf, features=0.6))
    assert top(many["g0"], 2) == {"tf0", "tf3"} and top(many["g1"], 1) == {"tf1"} and top(many["g2"], 2) == {"tf5", "tf6"}
    assert networks.factor_importances(expr, tf.limit(0)).count() == 0 and networks.factor_importances(expr.limit(0), tf).count() == 0


def test_trees_stop_without_signal():
    rng = np.random.default_rng(2)
    bins = networks.binned(rng.normal(size=(500, 6)))
    assert bins.max() == networks.BINS - 1 and np.bincount(bins[:, 0])[1:].min() > 10
    y = np.stack([rng.normal(size=500), (bins[:, 2] > 7) * 2.0 + rng.normal(size=500) * 0.1, np.ones(500)], axis=1)
    gains, grown = networks.Booster(bins, 3, 0.1, 300, 10, 0.9, 1.0, 10, [1]).importances(y)
    assert grown[0] < 60 < 300 and grown[1] > grown[0] and grown[2] == 0 and not gains[2].any()
    assert gains[1].argmax() == 2 and gains[1, 2] > 0.95 * gains[1].sum()
    one = [networks.Booster(bins, 3, 0.1, 300, 10, 0.9, 1.0, 10, [1]).importances(y[:, [k]])[0][0] for k in range(3)]
    assert np.allclose(gains, one)  # targets do not touch one another


def test_one_split_is_the_best_split():
    """A tree of depth 1 finds what a search over all bins finds."""
    rng = np.random.default_rng(3)
    bins, y = networks.binned(rng.normal(size=(300, 4))), rng.normal(size=300)
    gains = networks.Booster(bins, 1, 1.0, 1, 10, 1.0, 1.0, 5, [3])._trees(y[:, None], np.ones(300, bool), np.arange(4), np.array([-1]))[1][0]
    best = {}
    for j in range(4):
        for b in range(networks.BINS - 1):
            left = bins[:, j] <= b
            if 5 <= left.sum() <= 295:
                best[j, b] = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / 300
    (j, _), most = max(best.items(), key=lambda x: x[1])
    assert gains.argmax() == j and abs(gains[j] - most) < 1e-9 and (gains > 0).sum() == 1


def test_factors_of_few_cells_never_split_and_stay_behind(spark):
    """Drawn among all factors, those of at least `least` cells give what all of them give."""
    rng = np.random.default_rng(4)
    x = np.where(rng.random((400, 30)) < np.where(np.arange(30) % 3 == 0, 0.2, 0.01), rng.poisson(3.0, (400, 30)) + 1.0, 0.0)
    y = x[:, [0, 3, 6]] * 2 + rng.normal(size=(400, 3))
    often = np.flatnonzero((x > 0).sum(axis=0) >= 10)
    assert 0 < len(often) < 15
    whole, _ = networks.Booster(networks.binned(x), 3, 0.1, 40, 10, 0.9, "sqrt", 10, [1]).importances(y)
    part, _ = networks.Booster(networks.binned(x[:, often]), 3, 0.1, 40, 10, 0.9, "sqrt", 10, [1], often, 30).importances(y)
    assert np.array_equal(whole[:, often], part) and not np.delete(whole, often, axis=1).any() and part.any()
    expr, tf = frame(spark, x[:, np.setdiff1d(np.arange(30), often)], y)
    assert networks.factor_importances(expr, tf).count() == 0
