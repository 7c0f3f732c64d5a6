"""Canonical components against dense singular vectors, anchors by their definition, and batches that come to mix."""

import numpy as np

from helixframe.operators import canonical as C


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


def rows(df, name):
    return np.array([r[name] for r in df.orderBy("id").collect()])


def two(n=60, m=45, genes=24, seed=5):
    """Two batches of the same three kinds of rows, one of them shifted by a vector."""
    rng = np.random.default_rng(seed)
    kinds = rng.normal(size=(3, genes)) * 3
    ka, kb = np.arange(n) % 3, np.arange(m) % 3
    return kinds[ka] + rng.normal(size=(n, genes)) * 0.5, kinds[kb] + rng.normal(size=(m, genes)) * 0.5 + rng.normal(size=genes) * 1.5, ka, kb


def test_components_against_dense(spark):
    x, y, _, _ = two()
    u, v, s, loadings = C.canonical_vectors(table(spark, x), table(spark, y, 100), 5, power=6)
    du, ds, dv = np.linalg.svd(x @ y.T)
    assert np.allclose(s, ds[:5], rtol=1e-6)
    gu, gv = rows(u, "u"), rows(v, "u")
    assert np.allclose(gu.T @ gu, np.eye(5), atol=1e-6) and np.allclose(gv.T @ gv, np.eye(5), atol=1e-6)
    for j in range(5):
        sign = np.sign(gu[:, j] @ du[:, j])
        assert np.abs(gu[:, j] - sign * du[:, j]).max() < 1e-3 and np.abs(gv[:, j] - sign * dv[j]).max() < 1e-3
    assert np.allclose(loadings, x.T @ gu + y.T @ gv, rtol=1e-5, atol=1e-5)


def test_rank_below_components_and_empty_tables(spark):
    x, y, _, _ = two(genes=6)
    low = np.outer(np.arange(1.0, 9), np.ones(6))
    _, _, s, _ = C.canonical_vectors(table(spark, low), table(spark, y, 100), 4)
    assert len(s) == 1 and np.isclose(s[0], np.linalg.svd(low @ y.T)[1][0])
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert C.canonical_anchors(none, table(spark, y)).count() == 0
    flat = C.standardised(table(spark, [[2.0, 2.0], [1.0, 3.0]]))
    assert np.allclose(rows(flat, "embedding"), [[0, 0], [-(0.5**0.5), 0.5**0.5]])


def test_anchors_by_their_definition(spark):
    x, y, ka, kb = two()
    a, b = table(spark, x), table(spark, y, 100)
    got = {(r["a"], r["b"]): r["score"] for r in C.canonical_anchors(a, b, dims=4, k_anchor=5, k_filter=12, k_score=10, top=10).collect()}
    scale = lambda m: (m - m.mean(1, keepdims=True)) / m.std(1, ddof=1, keepdims=True)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    zx, zy = scale(x), scale(y)
    u, _, vt = np.linalg.svd(zx @ zy.T)
    u, v = u[:, :4], vt[:4].T
    genes = C.top_genes(zx.T @ u + zy.T @ v, 10)
    assert 0 < len(genes) <= 10

    def near(p, q, k, same=False):
        d = np.linalg.norm(p[:, None] - q[None], axis=2)
        if same:
            np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1, kind="stable")[:, :k]

    pu, pv = unit(u), unit(v)
    ab, ba = near(pu, pv, 10), near(pv, pu, 10)
    keep = near(unit(zx[:, genes]), unit(zy[:, genes]), 12)
    want = {(i, 100 + j) for i in range(60) for j in ab[i, :5] if i in ba[j, :5] and j in keep[i]}
    assert set(got) == want and len(want) > 10
    aa, bb = near(pu, pu, 10, True), near(pv, pv, 10, True)
    common = {(i, j): len(({*aa[i]} | {100 + k for k in ab[i]}) & ({*ba[j - 100]} | {100 + k for k in bb[j - 100]})) for i, j in want}
    low, high = np.percentile(list(common.values()), [1, 90])
    for p, c in common.items():
        assert abs(got[p] - np.clip((c - low) / (high - low), 0, 1)) < 1e-9
    assert np.mean([ka[i] == kb[j - 100] for i, j in got]) > 0.95


def test_batches_mix(spark):
    x, y, ka, kb = two()
    z, kz = x[:30] + 2.0, ka[:30]
    both = np.concatenate([x, y, z])
    kind = np.concatenate([ka, kb, kz])
    batch = np.repeat([0, 1, 2], [60, 45, 30])
    v = table(spark, both)
    of = spark.createDataFrame([(i, int(k)) for i, k in enumerate(batch)], "id long, batch int")
    out = rows(C.integrated(v, v, of, dims=4, k_weight=20, k_score=10), "embedding")
    assert out.shape == both.shape

    def apart(m):  # between means of a kind in two batches
        return max(np.linalg.norm(m[(batch == p) & (kind == k)].mean(0) - m[(batch == q) & (kind == k)].mean(0)) for k in range(3) for p in range(3) for q in range(p))

    assert apart(out) < 0.35 * apart(both)
    centre = np.stack([out[kind == k].mean(0) for k in range(3)])
    assert (np.linalg.norm(out[:, None] - centre[None], axis=2).argmin(1) == kind).all()


def test_tables_of_one_block_are_searched_exactly(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(C, "approximate_neighbours", lambda *_: None)
    v = spark.range(40_000).select("id", F.array(F.col("id").cast("double")).alias("embedding"))
    found = C._near(v, 2, v.filter("id in (0, 7000)"))
    assert sorted((r["id"], r["neighbour"]) for r in found.collect()) == [(0, 1), (0, 2), (7000, 6999), (7000, 7001)]
