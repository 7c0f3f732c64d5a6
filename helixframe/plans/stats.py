"""Statistics over orders, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import stats as S
from helixframe.plans import data as D
from helixframe.plans.registry import query


def _bulk(spark, sf_dir):
    """sample = market segment, gene = part, count = pieces."""
    return D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell").groupBy(F.col("segment").alias("sample"), "gene").agg(F.sum("raw").alias("count"))


def _lengths(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100.0).alias("length"))


_B = f"WITH {D.COUNTS}, {D.OBS}, bulk AS (SELECT segment AS sample, gene, CAST(sum(raw) AS BIGINT) AS count FROM counts JOIN obs USING (cell) GROUP BY 1, 2), len AS (SELECT p_partkey AS gene, p_size * 100.0 AS length FROM part)"


@query(f"{_B}, r AS (SELECT *, count / (length / 1000) AS rpk FROM bulk JOIN len USING (gene)) SELECT sample, gene, count, round(rpk / sum(rpk) OVER (PARTITION BY sample) * 1e6, 5) AS tpm FROM r")
def transcripts_per_million(spark, sf_dir):
    return D.rounded(S.tpm(_bulk(spark, sf_dir), _lengths(spark, sf_dir)), "tpm", digits=5)


@query(f"{_B} SELECT sample, gene, count, round(count / (length / 1000) / (sum(count) OVER (PARTITION BY sample) / 1e6), 5) AS rpkm FROM bulk JOIN len USING (gene)")
def reads_per_kilobase_million(spark, sf_dir):
    return D.rounded(S.rpkm(_bulk(spark, sf_dir), _lengths(spark, sf_dir)), "rpkm", digits=5)


@query(f"{_B} SELECT sample, gene, count, round(log2((count + 0.5) / (sum(count) OVER (PARTITION BY sample) + 1) * 1e6), 6) AS log_cpm FROM bulk")
def log_counts_per_million(spark, sf_dir):
    return D.rounded(S.log_cpm(_bulk(spark, sf_dir)), "log_cpm")


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT o_orderkey, o_orderpriority, round((o_totalprice - m) / nullif(b - a, 0), 6) AS scaled FROM orders JOIN q USING (o_orderpriority)")
def robust_scaled(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("value"))
    return D.rounded(S.robust_scaled(o, "o_orderpriority").drop("value"), "scaled")


@query("WITH r AS (SELECT user_id, value / 1000 AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS rn FROM events) SELECT user_id, round(sum(score / (rn * rn)) / sum(1.0 / (rn * rn)), 6) AS harmonic FROM r GROUP BY 1")
def harmonic_scores(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("user_id", (F.col("value") / 1000).alias("score"))
    return D.rounded(S.harmonic_score(e, "user_id"), "harmonic")


@query("""WITH e AS (SELECT user_id AS feature, event_type AS grp, value FROM events), m AS (SELECT feature, count(value) FILTER (grp = 'click') AS na, avg(value) FILTER (grp = 'click') AS ma, var_samp(value) FILTER (grp = 'click') AS va, count(value) FILTER (grp = 'error') AS nb, avg(value) FILTER (grp = 'error') AS mb, var_samp(value) FILTER (grp = 'error') AS vb FROM e WHERE grp IN ('click', 'error') GROUP BY 1),
g AS (SELECT *, na + nb AS n, (ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 0) AS raw FROM m),
h AS (SELECT *, raw * CASE WHEN n <= 50 THEN (n - 3) / (n - 2.25) * sqrt((n - 2) / n) ELSE 1 END AS es FROM g)
SELECT feature, round(es, 6) AS effect_size, round(sqrt(n / (na * nb) + es * es / (2 * n)), 6) AS standard_error FROM h WHERE na > 1 AND nb > 1""")
def hedges_effects(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("feature"), F.col("event_type").alias("grp"), "value")
    return D.rounded(S.hedges_g(e, "click", "error"), "effect_size", "standard_error").dropna()


@query("""WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), f AS (SELECT *, 2.0 * n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b)) AS f1 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY f1 DESC, b) AS rn FROM f)
SELECT a, b AS best_b, round(f1, 6) AS f1 FROM r WHERE rn = 1""")
def confusion_f1(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b"))
    return D.rounded(S.f1_confusion(c, "a", "b"), "f1")


@query("""WITH l AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), h AS (SELECT least(floor((c_acctbal - lo) / (hi - lo) * 100), 99) AS bin, lo, hi, count(*) AS c FROM customer CROSS JOIN l GROUP BY 1, 2, 3),
x AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 100 AS x FROM h), w AS (SELECT bin, x, sum(c) OVER u AS w0, sum(c * x) OVER u AS s0, sum(c) OVER () AS w, sum(c * x) OVER () AS s FROM x WINDOW u AS (ORDER BY bin)),
b AS (SELECT bin, x, CASE WHEN w > w0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END AS between_var FROM w)
SELECT round(x, 4) AS threshold FROM b ORDER BY between_var DESC, bin LIMIT 1""")
def otsu_threshold(spark, sf_dir):
    return D.rounded(S.otsu_threshold(D.table(spark, sf_dir, "customer"), "c_acctbal").select("threshold"), "threshold", digits=4)


@query(f"WITH {D.EXPR}, m AS (SELECT feature, 1.4826 * mad(value) AS mad FROM expr GROUP BY 1) SELECT feature, round(mad, 6) AS mad, row_number() OVER (ORDER BY mad DESC, feature) <= 10 AS is_hvg FROM m")
def variable_features_mad(spark, sf_dir):
    return D.rounded(S.mad_genes(D.expr(spark, sf_dir), 10), "mad")


@query(f"WITH {D.EXPR}, b AS (SELECT sample, feature, value, c_nationkey AS batch FROM expr JOIN customer ON sample = c_custkey) SELECT sample, feature, batch, round(value - avg(value) OVER (PARTITION BY feature, batch) + avg(value) OVER (PARTITION BY feature), 6) AS value FROM b")
def batch_centred_values(spark, sf_dir):
    e = D.expr(spark, sf_dir).join(D.obs(spark, sf_dir).select(F.col("cell").alias("sample"), "batch"), "sample")
    return D.rounded(S.batch_centred(e, "batch"), "value")


@query("""WITH r AS (SELECT event_type, user_id % 7 = 0 AS hit, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk FROM events),
g AS (SELECT event_type, count(*) FILTER (hit) AS p, count(*) AS n, sum(rk) FILTER (hit) AS s FROM r GROUP BY 1) SELECT event_type, round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM g""")
def score_auroc(spark, sf_dir):
    e = D.table(spark, sf_dir, "events").select("event_type", F.col("value").alias("score"), (F.col("user_id") % 7 == 0).alias("hit"))
    return D.rounded(S.auroc(e, ["event_type"]), "auc")


@query(f"WITH {D.EXPR}, z AS (SELECT feature AS component, sample AS feature, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM expr WINDOW w AS (PARTITION BY feature)) SELECT component, feature, round(z, 6) AS z FROM z WHERE abs(z) >= 2")
def module_membership(spark, sf_dir):
    e = D.expr(spark, sf_dir).select(F.col("feature").alias("component"), F.col("sample").alias("feature"), "value")
    return D.rounded(S.module_membership(e), "z")


@query(f"WITH {D.EXPR}, t AS (SELECT feature AS set_id, avg(value) AS threshold FROM expr GROUP BY 1) SELECT set_id, round(avg(CASE WHEN value > threshold THEN 1.0 ELSE 0.0 END), 6) AS on_fraction, count(*) AS n FROM expr JOIN t ON feature = set_id GROUP BY 1")
def binarised_activity(spark, sf_dir):
    e = D.expr(spark, sf_dir).select(F.col("feature").alias("set_id"), F.col("value").alias("score"))
    return D.rounded(S.binarised(e, e.groupBy("set_id").agg(F.avg("score").alias("threshold"))), "on_fraction")


@query("WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey AS id, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rk FROM customer), d AS (SELECT draw, rk, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', id, draw, 42))) AS pos FROM r CROSS JOIN range(1, 51) t(draw)) SELECT draw, round((sum(rk) - 30 * 31 / 2.0) / (30 * (max(n) - 30)), 6) AS auc FROM d CROSS JOIN n WHERE pos <= 30 GROUP BY 1")
def random_aurocs(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return D.rounded(S.random_aurocs(c, 30, 50), "auc")


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 4 + 1, 6) AS scaled FROM customer")
def range_normalised(spark, sf_dir):
    return D.rounded(S.range_normalised(D.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 1, 5).drop("c_acctbal"), "scaled")


@query(f"WITH {D.NORM}, t AS (SELECT c_custkey AS cell, c_acctbal / 10000 AS t FROM customer), g AS (SELECT cell, p, exp(-pow(t - p, 2) / 0.02) AS w FROM t CROSS JOIN (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p)), z AS (SELECT p, sum(w) AS z FROM g GROUP BY 1) SELECT p AS point, gene, round(sum(w * norm) / max(z), 6) AS trend FROM norm JOIN g USING (cell) JOIN z USING (p) GROUP BY 1, 2")
def gene_trends(spark, sf_dir):
    from helixframe.operators.cells import normalised

    t = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), (F.col("c_acctbal") / 10000).alias("t"))
    return D.rounded(S.trends(normalised(D.counts(spark, sf_dir)), t, [0, 0.25, 0.5, 0.75, 1], 0.1), "trend")


@query()
def module_eigengenes(spark, sf_dir):
    """Of brands by their last digit, over customers."""
    from helixframe.plans.pairwise import _dense, _modules

    return D.rounded(S.eigengenes(_dense(spark, sf_dir), _modules(spark, sf_dir)), "value", digits=4)
