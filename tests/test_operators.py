"""Operators against plain versions on small rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import special
from helixframe.functions.ranks import bh_adjusted
from helixframe.operators import cells, enrichment, graphs, ontology, pairwise
from helixframe.sources import matrix_market, store


def test_special_functions(spark):
    rows = spark.range(1, 200).select((F.col("id") / 4 + 0.5).alias("x")).select("x", special.lgamma(F.col("x")).alias("g"), special.normal_tail(F.col("x") - 5).alias("t")).collect()
    for r in rows:
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-11, abs=1e-11)
        assert r["t"] == pytest.approx(math.erfc((r["x"] - 5) / math.sqrt(2)) / 2, rel=1e-8, abs=1e-300)


def test_hypergeometric_tail(spark):
    cases = [(h, m, n, k) for n in (5, 26, 60) for m in (1, 3, n // 2, n) for k in (1, 3, n // 3, n) if m <= n and k <= n for h in range(max(0, m + k - n), min(m, k) + 1)]
    df = spark.createDataFrame(cases, "h int, m int, n int, k int").withColumn("p", special.hypergeometric_tail(*map(F.col, "hmnk")))
    for r in df.collect():
        want = sum(math.comb(r.m, i) * math.comb(r.n - r.m, r.k - i) for i in range(r.h, min(r.m, r.k) + 1)) / math.comb(r.n, r.k)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_odds_ratio_of_letters(spark):
    sets = spark.createDataFrame([("s", x) for x in "bcd"], "set_id string, member string")
    targets = spark.createDataFrame([("t", x) for x in "abc"], "target_id string, member string")
    universe = spark.createDataFrame([(chr(97 + i),) for i in range(26)], "member string")
    row = enrichment.hypergeometric(targets, sets, universe, min_overlap=2, threshold=None).first()
    assert (row.hits, row.odds_ratio) == (2, 44.0)
    assert enrichment.hypergeometric(targets.limit(0), sets, universe).count() == 0


def test_elimination(spark):
    """The deep term is significant, so its members no longer count for the root."""
    members = list(range(5))
    terms = spark.createDataFrame([("root", 0, m) for m in range(8)] + [("leaf", 1, m) for m in members], "term string, level int, member int")
    up = spark.createDataFrame([("leaf", "root")], "term string, ancestor string")
    targets = spark.createDataFrame([("t", m) for m in [*members, 7]], "target_id string, member int")
    rows = {r.term: r for r in enrichment.elimination(targets, terms, up, [0, 1], 100).collect()}
    assert rows["leaf"].hits == 5 and rows["leaf"].pval < 0.05
    assert (rows["root"].hits, rows["root"].term_size) == (1, 3)


@settings(max_examples=8, deadline=None)
@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_bh(spark, p):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "g string, i int, p double")
    got = [r.q for r in df.withColumn("q", bh_adjusted(F.col("p"), ["g"], F.lit(len(p)), ["i"])).orderBy("i").collect()]
    order, want, least = sorted(range(len(p)), key=lambda i: (p[i], i)), [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        want[order[rank - 1]] = least
    assert got == pytest.approx(want)


def test_page_rank(spark):
    edges = [(0, 1, 1.0), (1, 2, 2.0), (1, 0, 1.0), (2, 0, 1.0), (2, 3, 1.0)]
    got = {r.node: r.score for r in graphs.personalised_page_rank(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(0, 3.0), (2, 1.0)], "node long, score double")).collect()}
    w = np.zeros((4, 4))
    for a, b, x in edges:
        w[a, b] = x
    w = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    p = np.array([0.75, 0, 0.25, 0])
    r = p.copy()
    for _ in range(400):  # the fixed point, which the operator extrapolates to
        moved = 0.85 * r @ w
        r = moved + p * (1 - moved.sum())
    assert [got[i] for i in range(4)] == pytest.approx(r.tolist())
    assert sum(got.values()) == pytest.approx(1)


def test_label_propagation_sums_to_one(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (3, 2, 1.0)], "src long, dst long, weight double")
    out = graphs.label_propagation(e, spark.createDataFrame([(0, "a"), (3, "b"), (9, None)], "node long, label string"), rounds=6).collect()
    total = {}
    for r in out:
        total[r.node] = total.get(r.node, 0) + r.p
    assert all(v == pytest.approx(1) for v in total.values())
    shares = {(r.node, r.label): r.p for r in out}
    assert shares[2, "a"] == pytest.approx(0.8) and shares[2, "b"] == pytest.approx(0.2)


def test_components_and_neighbours(spark):
    x = np.random.default_rng(1).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = np.array([r.pc for r in graphs.principal_components(df, 3).orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = {(r.id, r["rank"]): r.neighbour for r in graphs.nearest_neighbours(df, 4, blocks=3).collect()}
    assert all(near[i, k + 1] == np.argsort(d[i])[k] for i in range(60) for k in range(4))


def test_imputation_and_autocorrelation(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (1, 1, 1.0), (2, 0, 2.0)], "src long, dst long, weight double")
    x = spark.createDataFrame([(0, 0, 4.0), (1, 0, 8.0), (2, 0, 0.0)], "cell long, gene long, norm double")
    m, v = np.array([[0, 0.25, 0.75], [0, 1, 0], [1, 0, 0]]), np.array([4.0, 8, 0])
    got = {r.cell: r.value for r in graphs.imputed(x, e, 3).collect()}
    assert [got[i] for i in range(3)] == pytest.approx((m @ m @ m @ v).tolist())
    z = (v - v.mean()) / v.std(ddof=1)
    g = graphs.local_autocorrelation(x.withColumnRenamed("norm", "value"), e).first()
    assert g.g == pytest.approx(1 * z[0] * z[1] + 3 * z[0] * z[2] + z[1] * z[1] + 2 * z[2] * z[0])


def test_vst_against_dense(spark):
    rng = np.random.default_rng(3)
    dense = rng.negative_binomial(2, 0.3, size=(80, 40)) * (rng.random((80, 40)) < 0.6)
    rows = [(int(c), int(g), int(dense[c, g])) for c, g in zip(*np.nonzero(dense), strict=True)]
    got = {r.gene: r for r in cells.vst_hvg(spark.createDataFrame(rows, "cell long, gene long, raw long"), 80, 5).collect()}
    mean, var = dense.mean(0), dense.var(0)
    expected = np.sqrt(10 ** cells._loess(np.log10(mean), np.log10(var), 0.3))
    z = np.clip((dense - mean) / expected, -math.sqrt(80), math.sqrt(80))
    assert [got[g].variance_std for g in range(40)] == pytest.approx(z.var(0).tolist(), rel=1e-6)
    assert sum(r.is_hvg for r in got.values()) == 5


def test_ontology_values(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "f")], "parent string, child string")
    c = ontology.ancestry(edges)
    ic = {r.term: r.ic for r in ontology.information_content(c).collect()}
    assert ic["a"] == pytest.approx(0) and ic["b"] == pytest.approx(math.log(2)) and ic["f"] == pytest.approx(math.log(6))
    assert {r.ancestor for r in c.filter("term = 'd'").collect()} == {"a", "b", "d"}
    loop = ontology.ancestry(spark.createDataFrame([("x", "y"), ("y", "x")], "parent string, child string"))
    assert loop.count() == 4


def test_permutations_do_not_depend_on_partitions(spark):
    stats = spark.createDataFrame([("a|b", i, float((i * 37) % 50 - 25)) for i in range(50)], "contrast string, feature long, stat double")
    sets = spark.createDataFrame([("s", i) for i in range(0, 50, 7)], "set_id string, member long")
    one, two = (enrichment.gsea_permutations(stats.repartition(n), sets, 20).collect() for n in (1, 5))
    assert len(one) == 1 and one == two and 0 < one[0].pval <= 1 and one[0].contrast == "a|b"


def test_pearson_equals_numpy_with_nulls_left_out(spark):
    x = np.random.default_rng(5).integers(0, 3, size=(30, 4))
    rows = [(int(s), int(f), float(x[s, f])) for s, f in zip(*np.nonzero(x), strict=True)]
    got = {(r.f1, r.f2): r.cor for r in pairwise.pearson(spark.createDataFrame(rows, "sample long, feature long, value double"), 30).collect()}
    want = np.corrcoef(x.T)
    assert all(got[i, j] == pytest.approx(want[i, j]) for i in range(4) for j in range(i + 1, 4))


def test_matrix_market_round_trip(spark, tmp_path):
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate integer general\n%c\n3 2 3\n1 1 5\n3 2 3\n2 1 7\n")
    counts, dims = matrix_market.read_matrix(spark, str(f))
    assert dims == (3, 2, 3)
    assert sorted(tuple(r) for r in counts.collect()) == [(0, 0, 5), (0, 1, 7), (1, 2, 3)]
    matrix_market.write_matrix(counts, str(tmp_path / "out"), 3, 2)
    text = spark.read.text(str(tmp_path / "out-header")).collect()[0].value + "\n" + spark.read.text(str(tmp_path / "out-header")).collect()[1].value
    assert text.endswith("3 2 3")
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_store(spark, tmp_path):
    counts = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 3)], "cell long, gene long, raw long")
    obs, var = counts.select("cell").distinct(), counts.select("gene").distinct()
    s = store.CellStore.create(counts, obs, var, str(tmp_path / "s"))
    assert s.counts().count() == 3
    kept = store.keep_cells(s.obs(), obs.filter("cell > 0"))
    assert kept.filter("to_keep").count() == 2 and kept.count() == 3
    assert store.keep_cells(kept, None).filter("to_keep").count() == 3
    assert store.with_columns(kept, kept.select("cell", F.lit(1).alias("to_keep"))).columns == ["cell", "to_keep"]
    with pytest.raises(ValueError):
        store.dropped(kept, ["cell"])
    assert store.snake_case(spark.range(1).withColumnRenamed("id", "nCount RNA")).columns == ["n_count_rna"]


def test_specific_markers_shuffle_counts_once(spark):
    """Counts meet by gene once, beside the join with the groups; of one group there are no rivals."""
    from helixframe.operators import cells

    norm = spark.createDataFrame([(c, c % 3, float(c % 4 + 1)) for c in range(1, 25)], "cell long, gene long, norm double")
    obs = spark.createDataFrame([(c, "abc"[c % 5 % 3]) for c in range(1, 31)] + [(31, None)], "cell long, grp string")
    out = cells.specific_markers(norm, obs, "grp")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    for r in out.collect():
        dense = {c: 0.0 for c in range(1, 31)} | {x["cell"]: x["norm"] for x in norm.collect() if x["gene"] == r["gene"]}
        of = lambda g: [v for c, v in dense.items() if "abc"[c % 5 % 3] == g]
        aucs = sorted(sum((x > y) + (x == y) / 2 for x in of(r["grp"]) for y in of(g)) / len(of(r["grp"])) / len(of(g)) for g in "abc" if g != r["grp"])
        assert abs(r["auc_min"] - aucs[0]) < 1e-9 and abs(r["auc_median"] - sum(aucs) / 2) < 1e-9 and abs(r["auc_mean"] - sum(aucs) / 2) < 1e-9 and r["rivals"] == 2
    assert cells.specific_markers(norm, obs.filter("grp = 'a'"), "grp").count() == 0


def test_specific_markers_of_large_groups(spark):
    """Products of the sizes of two groups of 70,000 cells are no integers of 32 bits."""
    from pyspark.sql import functions as F

    from helixframe.operators import cells

    obs = spark.range(140_000).select(F.col("id").alias("cell"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"))
    norm = obs.filter("grp = 'a' or cell < 35000").select("cell", F.lit(1).alias("gene"), F.lit(1.0).alias("norm"))
    got = {r["grp"]: (r["auc_min"], r["auc_mean"]) for r in cells.specific_markers(norm, obs, "grp").collect()}
    assert got == {"a": (0.875, 0.875), "b": (0.125, 0.125)}
