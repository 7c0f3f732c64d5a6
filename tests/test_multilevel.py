"""Multilevel p-values against all sets of small cases, and the operators built on them."""

import itertools
import math

import numpy as np
import pytest

from helixframe.operators import enrichment, multilevel


def all_scores(weights, m):
    n = len(weights)
    sets = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(n), m)), np.int8).reshape(-1, m)
    return np.concatenate([multilevel.scores(sets[k : k + 200_000].astype(np.int64), weights) for k in range(0, len(sets), 200_000)])


def test_functions():
    assert multilevel.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert multilevel.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert multilevel.digamma(20.5) - multilevel.digamma(19.5) == pytest.approx(1 / 19.5, abs=1e-10)


@pytest.mark.parametrize("seed", [1, 2])
def test_rare_scores_of_small_cases(seed):
    rng = np.random.default_rng(seed)
    weights = np.abs(np.sort(rng.normal(size=28))[::-1])
    exact = all_scores(weights, 8)  # 3.1 million sets
    up = np.sort(exact[exact >= 0])
    targets = [float(up[-1]), float(up[-30]), float(up[-3000]), float(up[len(up) // 2])]
    down = np.sort(exact[exact <= 0])
    targets.append(float(down[0]))
    got = multilevel._of_one_size(weights, 8, targets, 1000, 201, 1e-50, 7)
    share = lambda e: (exact >= e - 1e-12).sum() / (exact >= 0).sum() if e > 0 else (exact <= e + 1e-12).sum() / (exact <= 0).sum()
    assert share(targets[0]) < 1e-6 and share(targets[4]) < 1e-6
    for e, (nes, p, err) in zip(targets, got, strict=True):
        assert abs(math.log2(p / share(e))) < 4 * err + 0.1, (e, p, share(e), err)
        assert nes == pytest.approx(e / abs(exact[exact * np.sign(e) >= 0].mean()), rel=0.1)


def test_bound_of_p():
    weights = np.abs(np.sort(np.random.default_rng(3).normal(size=400))[::-1])
    best = multilevel.scores(np.arange(20)[None], weights)[0]
    nes, p, err = multilevel._of_one_size(weights, 20, [float(best)], 200, 101, 1e-8, 1)[0]
    assert p == 1e-8 and math.isnan(err)
    _, p, err = multilevel._of_one_size(weights, 20, [float(best)], 200, 101, 1e-60, 1)[0]
    assert 1e-40 < p < 1e-25 and err < 2.5  # one of C(400, 20) = 2.8e33 sets


def stats_and_sets(spark):
    rng = np.random.default_rng(11)
    stats = [(c, f"f{i:03}", float(x)) for c in ("a", "b") for i, x in enumerate(rng.normal(size=300))]
    rank = sorted((s for s in stats if s[0] == "a"), key=lambda s: -s[2])
    sets = [("top", f) for _, f, _ in rank[:15]] + [("bottom", f) for _, f, _ in rank[-15:]] + [(f"r{k}", f"f{i:03}") for k in range(6) for i in rng.choice(300, 15 + k % 2, replace=False)]
    return spark.createDataFrame(stats, "contrast string, feature string, stat double"), spark.createDataFrame(sets, "set_id string, member string")


def test_multilevel_enrichment(spark):
    stats, sets = stats_and_sets(spark)
    got = {(r["contrast"], r["set_id"]): r for r in multilevel.multilevel_enrichment(stats, sets).collect()}
    real = {(r["contrast"], r["set_id"]): r["es"] for r in enrichment.gsea_statistic(stats, sets).collect()}
    assert {k: r["es"] for k, r in got.items()} == pytest.approx(real) and len(got) == 16
    assert got["a", "top"]["pval"] < 1e-12 and got["a", "bottom"]["pval"] < 1e-12 and got["a", "bottom"]["nes"] < -1
    assert got["b", "top"]["pval"] > 1e-5 and all(0 < r["pval"] <= r["fdr"] <= 1 for r in got.values())
    again = {(r["contrast"], r["set_id"]): r for r in multilevel.multilevel_enrichment(stats.repartition(7), sets).collect()}
    assert {k: r["pval"] for k, r in again.items()} == pytest.approx({k: r["pval"] for k, r in got.items()}, rel=1e-9)
    assert multilevel.multilevel_enrichment(stats.limit(0), sets).count() == 0


def test_sets_of_one_contrast(spark):
    stats, sets = stats_and_sets(spark)
    from pyspark.sql import functions as F

    both = stats.select("contrast").distinct().crossJoin(sets)
    key = lambda df: sorted((*r[:-1], round(r[-1], 9)) for r in df.collect())
    assert key(enrichment.gsea_statistic(stats, both)) == key(enrichment.gsea_statistic(stats, sets))
    one = both.filter((F.col("contrast") == "a") | (F.col("set_id") != "top"))
    assert enrichment.gsea_statistic(stats, one).count() == 15
    assert key(enrichment.permuted_statistics(stats, both, 3)) == key(enrichment.permuted_statistics(stats, sets, 3))


def test_elimination(spark):
    stats, sets = stats_and_sets(spark)
    from pyspark.sql import functions as F

    low = sets.select(F.col("set_id").alias("term"), F.lit(1).alias("level"), "member")
    high = sets.filter("set_id in ('top', 'r0')").select(F.lit("both").alias("term"), F.lit(0).alias("level"), "member").distinct()
    up = spark.createDataFrame([("top", "both"), ("r0", "both")], "term string, ancestor string")
    got = {(r["contrast"], r["term"]): r for r in multilevel.multilevel_elimination(stats, low.unionByName(high), up, [0, 1], elim_threshold=1e-6).collect()}
    n = high.count()
    assert got["a", "both"]["size"] == n - 15 and got["b", "both"]["size"] == n


def test_statistics_are_dealt_once(spark):
    """Places of dealt statistics by their definition, ties to the smaller feature; sets that are too large meet none."""
    import hashlib

    stat = {f: float(f * 7 % 5) for f in range(12)}
    stats = spark.createDataFrame([("c", f, s) for f, s in stat.items()], "contrast string, feature long, stat double")
    dealt = enrichment.dealt_statistics(stats, 2, 42)
    got = {(r["perm"], r["feature"]): (r["stat"], r["at"]) for r in dealt.collect()}
    for perm in (1, 2):
        names = sorted(stat, key=lambda f: hashlib.md5(f"{f}|{perm}|42".encode()).hexdigest())
        values = dict(zip(names, sorted(stat.values(), reverse=True), strict=True))
        for at, f in enumerate(sorted(stat, key=lambda f: (-values[f], f)), 1):
            assert got[perm, f] == (values[f], at)
    sets = spark.createDataFrame([("small", f) for f in range(5)] + [("large", f) for f in range(11)], "set_id string, member long")
    null = enrichment.permuted_statistics(stats, sets, 2, 42, max_size=8, dealt=dealt)
    assert sorted(r["set_id"] for r in null.collect()) == ["small", "small"]


def test_statistics_travel_in_chunks(spark, monkeypatch):
    """No row holds a contrast's statistics, and the places found over ranges are those of the window."""
    stats, sets = stats_and_sets(spark)
    monkeypatch.setattr(multilevel, "CHUNK", 64)
    got = {(r["contrast"], r["set_id"]): r for r in multilevel.multilevel_enrichment(stats, sets).collect()}
    whole = {(r["contrast"], r["set_id"]): r for r in enrichment.gsea_statistic(stats, sets).collect()}
    assert got.keys() == whole.keys() and all(got[k]["es"] == pytest.approx(whole[k]["es"], abs=1e-12) for k in got)
    for c in ("a", "b"):
        weights = np.array([abs(r["stat"]) for r in stats.filter(stats["contrast"] == c).collect()])
        value = np.array([r["stat"] for r in stats.filter(stats["contrast"] == c).collect()])
        weights = weights[np.argsort(-value)]
        for size in (15, 16):
            mine = sorted((s, r["es"]) for (k, s), r in got.items() if k == c and r["size"] == size)
            expected = multilevel._of_one_size(weights, size, [e for _, e in mine], 1000, 101, 1e-50, 42)
            assert [got[c, s]["pval"] for s, _ in mine] == pytest.approx([p for _, p, _ in expected], rel=1e-9)


def test_digests_of_many_texts():
    import hashlib

    import pyarrow as pa

    from helixframe.functions.digests import Texts

    texts = ["", "a", "abcd", "x" * 49, "x" * 60, "é漢"] + [str(i) for i in range(20_000)]
    for tail in (b"|1|42", b"|100|42"):
        got = Texts(pa.chunked_array([texts[:4], texts[4:]])).digests(tail)
        want = np.frombuffer(b"".join(hashlib.md5(t.encode() + tail).digest() for t in texts), ">u8").reshape(-1, 2)
        assert (got == want).all()


def test_permuted_statistics_are_no_rows(spark, monkeypatch):
    """Tests count inside tasks what the rows of permuted statistics give, ties and overlapping sets included."""
    from pyspark.sql import functions as F

    stats, sets = stats_and_sets(spark)
    stats = stats.withColumn("stat", F.round("stat", 1))
    real, null = enrichment.gsea_statistic(stats, sets), enrichment.permuted_statistics(stats, sets, 30)
    both = real.join(null, ["contrast", "set_id"]).collect()
    want = {}
    for r in both:
        alike = np.sign(r["null_es"]) == np.sign(r["es"])
        at = want.setdefault((r["contrast"], r["set_id"]), [r["size"], r["es"], 0, 0])
        at[2] += int(alike and abs(r["null_es"]) >= abs(r["es"]))
        at[3] += int(alike)
    monkeypatch.setattr(enrichment, "dealt_statistics", None)
    got = {(r["contrast"], r["set_id"]): r for r in enrichment.gsea_permutations(stats, sets, 30).collect()}
    assert got.keys() == want.keys()
    for key, (size, es, far, same) in want.items():
        assert got[key]["size"] == size and got[key]["es"] == pytest.approx(es, abs=1e-12) and got[key]["pval"] == (far + 1) / (same + 1)
    one = sets.select(F.col("set_id").alias("term"), F.lit(0).alias("level"), "member")
    up = spark.createDataFrame([], "term string, ancestor string")
    eliminated = enrichment.gsea_elimination(stats, one, up, [0], 30).collect()
    assert {(r["contrast"], r["term"]): r["pval"] for r in eliminated} == {k: r["pval"] for k, r in got.items()}


def test_elimination_of_large_sets(spark):
    """Without a limit sets of any size are tested; the query has neither a limit nor too few permutations for its threshold."""
    import inspect

    from helixframe.plans import enrichment as plans
    from helixframe.plans import registry

    stats = spark.createDataFrame([("c", f, float(700 - f)) for f in range(700)], "contrast string, feature long, stat double")
    terms = spark.createDataFrame([("low", 1, f) for f in range(20)] + [("high", 0, f) for f in range(620)], "term string, level int, member long")
    up = spark.createDataFrame([("low", "high")], "term string, ancestor string")
    got = {r["term"]: r["size"] for r in enrichment.gsea_elimination(stats, terms, up, [0, 1], 100, max_size=None).collect()}
    assert got == {"low": 20, "high": 600}  # the members of a significant term are gone
    assert "500" not in registry.oracle_sql()["gsea_elimination"] and "max_size=None" in inspect.getsource(plans.gsea_elimination)
