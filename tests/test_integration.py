"""Communities, factors and integration against plain versions on small rows."""

import numpy as np
import pytest

from helixframe.operators import communities, factors, graphs, integration

EDGES = "src long, dst long, weight double"


def planted(groups=4, size=12, seed=2):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i // size == j // size else 0.03)]


def plain_modularity(edges, label):
    k, m2, inner = {}, 0.0, 0.0
    for a, b, w in edges:
        m2 += 2 * w
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inner += 2 * w * (label[a] == label[b])
    total = {}
    for x, d in k.items():
        total[label[x]] = total.get(label[x], 0) + d
    return inner / m2 - sum(t * t for t in total.values()) / m2**2


def test_louvain_finds_planted_groups(spark):
    edges = planted()
    df = spark.createDataFrame([*edges, (0, 99, 0.0), (None, 1, 1.0)], EDGES)
    got = {r.node: r.label for r in communities.louvain(df, levels=3, rounds=6).collect()}
    assert sorted(got) == list(range(48)) and all(got[label] == label for label in got.values())
    truth = {i: i // 12 for i in range(48)}
    assert plain_modularity(edges, got) >= plain_modularity(edges, truth) - 0.02
    labels = spark.createDataFrame(list(got.items()), "node long, label long")
    assert communities.modularity(df, labels) == pytest.approx(plain_modularity(edges, got))
    assert communities.louvain(df.limit(0)).count() == 0


def test_smoothed_signal_is_a_heat_kernel(spark):
    edges = planted(2, 6)
    a = np.zeros((12, 12))
    for i, j, w in edges:
        a[i, j] = a[j, i] = w
    d = a.sum(1)
    values, basis = np.linalg.eigh(np.eye(12) - a / np.sqrt(np.outer(d, d)))
    x = np.zeros(12)
    x[[0, 3, 7]] = 1, 2, -1
    want = basis @ (np.exp(-1.5 * values) * (basis.T @ x))
    signal = spark.createDataFrame([(0, "a", 1.0), (3, "a", 2.0), (7, "a", -1.0)], "node long, label string, value double")
    got = {r.node: r.value for r in communities.smoothed_signal(spark.createDataFrame(edges, EDGES), signal, 1.5, 14).collect()}
    assert [got[i] for i in range(12)] == pytest.approx(want.tolist(), abs=1e-8)


def test_independent_components_recover_sources(spark):
    rng = np.random.default_rng(4)
    s = np.stack((rng.exponential(size=800), rng.uniform(-1, 1, 800) ** 3, rng.choice([-1.0, 1.0], 800)), 1)
    x = s @ rng.normal(size=(3, 5))
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (9999, None)], "id long, embedding array<double>")
    for how in ("logcosh", "exp"):
        got = np.array([r.ic for r in factors.independent_components(df, 3, how, rounds=40).orderBy("id").collect()])
        cor = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
        assert sorted(cor.argmax(1)) == [0, 1, 2] and (cor.max(1) > 0.97).all()
        assert got.std(0) == pytest.approx(1)
    assert factors.independent_components(df.limit(0), 3).count() == 0


def test_nonnegative_factors_rebuild_the_rows(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((60, 3)) ** 3) @ (rng.random((3, 8)) ** 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    rows, h = factors.nonnegative_factors(df, 3, rounds=25)
    w = np.array([r.weights for r in rows.orderBy("id").collect()])
    assert (w >= 0).all() and (h > 0).all() and h.sum(1) == pytest.approx(1)
    assert np.linalg.norm(w @ h - x) / np.linalg.norm(x) < 0.08
    assert factors.nonnegative_factors(df.limit(0), 3)[0].count() == 0


def test_matched_batch(spark):
    """A batch that is the reference moved by a constant comes back; one without anchors stays."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 3)) * 5
    ref = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    moved = spark.createDataFrame([(100 + i, (v + 0.1).tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    pairs = {(r.a, r.b) for r in integration.mutual_neighbours(moved, ref, 1, blocks=2).collect()}
    assert pairs == {(100 + i, i) for i in range(40)}
    got = np.array([r.embedding for r in integration.matched_batch(moved, ref, 1, smooth=4, blocks=2).orderBy("id").collect()])
    assert got == pytest.approx(x)
    same = integration.matched_batch(moved, ref.limit(0), 1, blocks=2).orderBy("id").collect()
    assert np.array([r.embedding for r in same]) == pytest.approx(x + 0.1)


def test_labels_and_meta_cells(spark):
    knn = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 9)], "id long, neighbour long")
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (9, None)], "id long, label string")
    got = {r.id: (r.label, r.share) for r in integration.transferred_labels(knn, labels).collect()}
    assert got[0] == ("b", pytest.approx(2 / 3)) and got[1] == ("a", 0.5) and 2 not in got
    counts = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (3, 5, 4)], "cell long, gene long, raw long")
    meta = {(r.meta, r.gene): r.raw for r in integration.meta_cells(counts, knn, spark.createDataFrame([(0,), (0,)], "id long")).collect()}
    assert meta == {(0, 0): 3, (0, 5): 4}
    pairs = spark.createDataFrame([(70, 0, 1), (71, 3, 3), (72, 8, 9)], "cell long, first long, second long")
    assert {(r.cell, r.gene): r.raw for r in integration.simulated_doublets(counts, pairs).collect()} == {(70, 0): 3, (71, 5): 8}
    assert graphs.shared_neighbours(knn.limit(0)).count() == 0
