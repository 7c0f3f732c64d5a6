"""Agglomerative trees against merging one pair after another, and cuts."""

import numpy as np
import pytest

from helixframe.operators import trees


def plain(d, linkage):
    """[(a, b, height, size)] by merging the nearest pair again and again."""
    d = {frozenset(p): x for p, x in d.items()}
    size = {v: 1 for p in d for v in p}
    out = []
    while len(size) > 1:
        x, a, b = min((x, *sorted(p)) for p, x in d.items())
        out.append((a, b, x, size[a] + size[b]))
        for c in size:
            if c not in (a, b):
                d1, d2, n1, n2, n = d[frozenset((a, c))], d.pop(frozenset((b, c))), size[a], size[b], size[c]
                d[frozenset((a, c))] = {"average": (n1 * d1 + n2 * d2) / (n1 + n2), "complete": max(d1, d2), "single": min(d1, d2), "ward": ((n1 + n) * d1 + (n2 + n) * d2 - n * x) / (n1 + n2 + n)}[linkage]
        del d[frozenset((a, b))]
        size[a] += size.pop(b)
    return out


def points(n=18, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return {(f"n{i:02}", f"n{j:02}"): float(np.linalg.norm(x[i] - x[j])) for i in range(n) for j in range(i + 1, n)}


@pytest.mark.parametrize("linkage", ["average", "ward", "complete"])
def test_same_tree_as_pair_by_pair(spark, linkage):
    d = points(11)
    got = trees.agglomerated(spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a string, b string, distance double"), linkage).orderBy("step").collect()
    want = plain(d, linkage)
    assert [(r["a"], r["b"], r["size"]) for r in got] == [(a, b, n) for a, b, _, n in want]
    assert np.allclose([r["height"] for r in got], [x for _, _, x, _ in want]) and [r["step"] for r in got] == list(range(1, 11))


def test_cuts(spark):
    d = points(12, 4)
    merges = trees.agglomerated(spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a string, b string, distance double"))
    got = {}
    for r in trees.cut_trees(merges, [1, 3, 7, 12]).collect():
        got.setdefault(r["k"], {})[r["node"]] = r["label"]
    for k in (1, 3, 7, 12):
        label = {v: v for p in d for v in p}
        for a, b, _, _ in plain(d, "average")[: 12 - k]:
            label = {v: a if x == b else x for v, x in label.items()}
        assert got[k] == label and len(set(label.values())) == k
    none = trees.agglomerated(spark.createDataFrame([], "a string, b string, distance double"))
    assert none.count() == 0


def test_modules_of_correlated_features(spark):
    rng = np.random.default_rng(5)
    hidden = rng.normal(size=(200, 3))
    x = np.concatenate([hidden[:, [g]] + 0.4 * rng.normal(size=(200, 6)) for g in range(3)] + [rng.normal(size=(200, 6))], axis=1)
    c = np.corrcoef(x.T)
    rows = [(f"f{i:02}", f"f{j:02}", float(c[i, j])) for i in range(24) for j in range(i + 1, 24)]
    modules, curve = trees.correlation_modules(spark.createDataFrame(rows, "f1 string, f2 string, cor double"), k_max=20, junk=0.2)
    by = {}
    for r in modules.collect():
        by.setdefault(r["label"], set()).add(int(r["node"][1:]))
        assert r["r2"] > 0.2
    assert sorted(map(sorted, by.values())) == [list(range(0, 6)), list(range(6, 12)), list(range(12, 18))]
    assert curve.count() == 19
    label = spark.createDataFrame([(1, f"f{i:02}", "all") for i in range(24)] + [(2, "f00", "one")], "k int, node string, label string")
    got = {r["k"]: r for r in trees.cut_quality(label, spark.createDataFrame(rows[:200], "f1 string, f2 string, cor double")).collect()}
    assert got[1]["r2"] == pytest.approx(np.median([r[2] ** 2 for r in rows[:200]] + [0.0] * (len(rows) - 200))) and got[2]["r2"] is None
