"""Pairs of brands over customers, and of sets of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import communities as C
from helixframe.operators import pairwise as P
from helixframe.operators import trees as T
from helixframe.plans import data as D
from helixframe.plans.registry import query

_PAIR = "FROM dense a JOIN dense b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2"
_D = f"WITH {D.DENSE}"


def _n(spark, sf_dir) -> int:
    return D.expr(spark, sf_dir).select("sample").distinct().count()


def _dense(spark, sf_dir):
    e = D.expr(spark, sf_dir)
    return P.completed(e, e.select("sample"), D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature")))


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS cor {_PAIR}")
def correlation_pearson(spark, sf_dir):
    return D.rounded(P.pearson(D.expr(spark, sf_dir)), "cor")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(covar_samp(a.value, b.value), 4) AS cov {_PAIR}")
def covariance(spark, sf_dir):
    return D.rounded(P.covariance(D.expr(spark, sf_dir)), "cov", digits=4)


@query(f"{_D}, r AS (SELECT sample, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM dense) SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS cor {_PAIR.replace('dense', 'r')}")
def correlation_spearman(spark, sf_dir):
    return D.rounded(P.spearman(D.expr(spark, sf_dir)), "cor")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(1 - abs(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))), 6) AS distance {_PAIR}")
def cosine_distance(spark, sf_dir):
    return D.rounded(P.cosine_distance(D.expr(spark, sf_dir)), "distance")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(sqrt(sum(pow(a.value - b.value, 2))), 6) AS distance {_PAIR}")
def euclidean_distance(spark, sf_dir):
    return D.rounded(P.minkowski(D.expr(spark, sf_dir), "euclidean"), "distance")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(sum(abs(a.value - b.value)), 6) AS distance {_PAIR}")
def manhattan_distance(spark, sf_dir):
    return D.rounded(P.minkowski(D.expr(spark, sf_dir), "manhattan"), "distance")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(sum(CASE WHEN a.value + b.value = 0 THEN 0 ELSE abs(a.value - b.value) / (a.value + b.value) END), 6) AS distance {_PAIR}")
def canberra_distance(spark, sf_dir):
    return D.rounded(P.minkowski(D.expr(spark, sf_dir), "canberra"), "distance")


def _halves(spark, sf_dir):
    e = D.expr(spark, sf_dir)
    a, b = e.filter("sample % 2 = 0"), e.filter("sample % 2 = 1")
    return a, a.select("sample").distinct().count(), b, b.select("sample").distinct().count()


@query(f"""{_D}, c AS (SELECT a.sample % 2 AS half, a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS cor, count(*) AS n FROM dense a JOIN dense b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2, 3)
SELECT x.f1, x.f2, round(x.cor, 6) AS cor_a, round(y.cor, 6) AS cor_b, round((atanh(x.cor) - atanh(y.cor)) / sqrt(1 / (x.n - 3) + 1 / (y.n - 3)), 5) AS z FROM c x JOIN c y ON x.f1 = y.f1 AND x.f2 = y.f2 AND x.half = 0 AND y.half = 1""")
def differential_correlation(spark, sf_dir):
    return D.rounded(D.rounded(P.differential_correlation(*_halves(spark, sf_dir)), "cor_a", "cor_b"), "z", digits=5)


@query(f"""{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, abs(corr(a.value, b.value)) AS a {_PAIR}), s AS (SELECT f1, f2, a FROM c UNION ALL SELECT f2, f1, a FROM c), k AS (SELECT f1 AS f, sum(a) AS k FROM s GROUP BY 1),
l AS (SELECT x.f1, y.f2, sum(x.a * y.a) AS l FROM s x JOIN s y ON x.f2 = y.f1 AND x.f1 < y.f2 GROUP BY 1, 2)
SELECT c.f1, c.f2, round((l + a) / (least(k1.k, k2.k) + 1 - a), 6) AS tom FROM c JOIN l ON l.f1 = c.f1 AND l.f2 = c.f2 JOIN k k1 ON k1.f = c.f1 JOIN k k2 ON k2.f = c.f2""")
def topological_overlap(spark, sf_dir):
    return D.rounded(P.topological_overlap(P.pearson(D.expr(spark, sf_dir))), "tom")


_SIM = """, a AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), j AS (SELECT x.set_id AS l, y.set_id AS r, count(*) AS shared FROM sets x JOIN sets y ON x.member = y.member GROUP BY 1, 2)
SELECT l, r, shared, round(shared / {0}, 6) AS similarity FROM j JOIN a x ON x.set_id = l JOIN a y ON y.set_id = r"""


@query(f"WITH {D.SETS}" + _SIM.format("(x.n + y.n - shared)"))
def set_similarity_jaccard(spark, sf_dir):
    s = D.sets(spark, sf_dir)
    return D.rounded(P.set_similarity(s, s), "similarity")


@query(f"WITH {D.SETS}" + _SIM.format("least(x.n, y.n)"))
def set_similarity_overlap(spark, sf_dir):
    s = D.sets(spark, sf_dir)
    return D.rounded(P.set_similarity(s, s, overlap=True), "similarity")


@query("""WITH m AS (SELECT 'brand' AS origin, p_brand AS set_id, p_partkey AS member FROM part UNION ALL SELECT 'type', p_type, p_partkey FROM part UNION ALL SELECT 'size', 'size ' || p_size, p_partkey FROM part),
n AS (SELECT origin, set_id, count(*) AS n FROM m GROUP BY 1, 2), j AS (SELECT x.origin AS oa, x.set_id AS ma, y.origin AS ob, y.set_id AS mb, count(*) AS c FROM m x JOIN m y ON x.member = y.member AND x.origin < y.origin GROUP BY 1, 2, 3, 4),
s AS (SELECT j.*, c / (a.n + b.n - c) AS sim FROM j JOIN n a ON a.origin = oa AND a.set_id = ma JOIN n b ON b.origin = ob AND b.set_id = mb),
r AS (SELECT *, rank() OVER (PARTITION BY oa, ma, ob ORDER BY round(sim, 9) DESC) AS r1, rank() OVER (PARTITION BY ob, mb, oa ORDER BY round(sim, 9) DESC) AS r2 FROM s WHERE sim >= 0.01)
SELECT oa AS origin_a, ma AS module_a, ob AS origin_b, mb AS module_b, round(sim, 6) AS similarity FROM r WHERE r1 = 1 AND r2 = 1""")
def reciprocal_best_hits(spark, sf_dir):
    return D.rounded(P.reciprocal_best_hits(_part_modules(spark, sf_dir), 0.01), "similarity")


@query()
def hit_communities(spark, sf_dir):
    """Communities of brands, types and sizes that are each other's best hits, at several resolutions."""
    return D.rounded(C.hit_communities(P.reciprocal_best_hits(_part_modules(spark, sf_dir), 0.01), C.resolution_steps(0.5, 5.0, 4)), "modularity")


def _part_modules(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    return p.select(F.explode(F.array(*(F.struct(F.lit(o).alias("origin"), c.alias("set_id")) for o, c in (("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.concat(F.lit("size "), F.col("p_size").cast("string"))))))).alias("o"), F.col("p_partkey").alias("member")).select("o.*", "member")


@query(f"""{_D}, lim AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM dense GROUP BY 1), b AS (SELECT sample, feature, CAST(least(floor((value - lo) / nullif(hi - lo, 0) * 8), 7) AS INT) AS b FROM dense JOIN lim USING (feature)),
p AS (SELECT feature, b, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM b GROUP BY 1, 2), h AS (SELECT feature, -sum(p * ln(p)) AS h FROM p GROUP BY 1),
jc AS (SELECT x.feature AS f1, y.feature AS f2, x.b AS b1, y.b AS b2, count(*) AS c FROM b x JOIN b y ON x.sample = y.sample AND x.feature < y.feature GROUP BY 1, 2, 3, 4),
jp AS (SELECT f1, f2, c / sum(c) OVER (PARTITION BY f1, f2) AS p FROM jc), jh AS (SELECT f1, f2, -sum(p * ln(p)) AS h12 FROM jp GROUP BY 1, 2)
SELECT f1, f2, round(x.h + y.h - h12, 6) AS mi, round((x.h + y.h - h12) / sqrt(x.h * y.h), 6) AS nmi FROM jh JOIN h x ON x.feature = f1 JOIN h y ON y.feature = f2""")
def mutual_information(spark, sf_dir):
    return D.rounded(P.mutual_information(_dense(spark, sf_dir), 8), "mi", "nmi")


@query(f"""WITH {D.EXPR}, t AS (SELECT sample, feature FROM expr WHERE value >= 40), n AS (SELECT count(DISTINCT sample) AS n FROM expr), c AS (SELECT feature, count(*) AS c FROM t GROUP BY 1),
j AS (SELECT x.feature AS f1, y.feature AS f2, count(*) AS c12 FROM t x JOIN t y ON x.sample = y.sample AND x.feature < y.feature GROUP BY 1, 2)
SELECT f1, f2, round(ln(c12 * n / (x.c * y.c)), 6) AS pmi, round(ln(c12 * n / (x.c * y.c)) / -ln(c12 / n), 6) AS npmi FROM j CROSS JOIN n JOIN c x ON x.feature = f1 JOIN c y ON y.feature = f2""")
def pointwise_information(spark, sf_dir):
    return D.rounded(P.pointwise_information(D.expr(spark, sf_dir).filter("value >= 40"), _n(spark, sf_dir)), "pmi", "npmi")


def _attributes(spark, sf_dir):
    """Nations compared by the most common segment of each tenth customer number."""
    c = D.table(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_custkey") % 10).alias("sample"), F.col("c_nationkey").alias("feature")).agg(F.min("c_mktsegment").alias("value"), F.avg("c_acctbal").alias("number"))


_ATTR = "WITH t AS (SELECT c_custkey % 10 AS sample, c_nationkey AS feature, min(c_mktsegment) AS value, avg(c_acctbal) AS number FROM customer GROUP BY 1, 2)"


@query(f"{_ATTR} SELECT a.feature AS f1, b.feature AS f2, round(avg(CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END), 6) AS distance FROM t a JOIN t b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2")
def hamming_distance(spark, sf_dir):
    return D.rounded(P.hamming(_attributes(spark, sf_dir)), "distance")


@query(f"{_ATTR}, r AS (SELECT *, max(number) OVER (PARTITION BY sample) - min(number) OVER (PARTITION BY sample) AS reach FROM t) SELECT a.feature AS f1, b.feature AS f2, round(avg((CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END + abs(a.number - b.number) / a.reach) / 2), 6) AS distance FROM r a JOIN r b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2")
def gower_distance(spark, sf_dir):
    t = _attributes(spark, sf_dir)
    return D.rounded(P.gower(t.select("sample", "feature", F.col("number").alias("value")), t), "distance")


@query(f"{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, 1 - abs(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))) AS distance {_PAIR}) SELECT f1, f2, round(distance, 6) AS distance, round(exp(-pow(2 * distance, 2)), 6) AS affinity FROM c")
def radial_affinity(spark, sf_dir):
    return D.rounded(P.radial(P.cosine_distance(D.expr(spark, sf_dir)), "distance", 2.0), "distance", "affinity")


@query(f"""{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, abs(corr(a.value, b.value)) AS a {_PAIR}), k AS (SELECT f, sum(a) AS k FROM (SELECT f1 AS f, a FROM c UNION ALL SELECT f2, a FROM c) GROUP BY 1), lim AS (SELECT min(k) AS lo, max(k) AS hi, count(*) AS n FROM k),
h AS (SELECT least(floor((k - lo) / nullif(hi - lo, 0) * 10), 9) AS b, avg(k) AS mean, count(*) / max(n) AS p FROM k CROSS JOIN lim GROUP BY 1) SELECT round(regr_r2(log10(p), log10(mean)), 6) AS r2, round(regr_slope(log10(p), log10(mean)), 6) AS slope FROM h WHERE mean > 0""")
def scale_free_topology(spark, sf_dir):
    c = P.pearson(D.expr(spark, sf_dir)).withColumn("cor", F.abs("cor"))
    return D.rounded(P.scale_free_fit(c, "cor", 10), "r2", "slope")


def _classes(spark, sf_dir):
    """sample = customer, feature = class of size."""
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 5).cast("long").alias("feature"))
    return D.counts(spark, sf_dir).join(p, "gene").groupBy(F.col("cell").alias("sample"), "feature").agg(F.sum("raw").cast("double").alias("value"))


@query(f"""{_D}, m AS (SELECT cell AS sample, CAST(p_size % 5 AS BIGINT) AS feature, CAST(sum(raw) AS DOUBLE) AS value FROM counts JOIN part ON gene = p_partkey GROUP BY 1, 2), md AS (SELECT s.sample, f.feature, coalesce(m.value, 0.0) AS value FROM (SELECT DISTINCT sample FROM expr) s CROSS JOIN (SELECT DISTINCT feature FROM m) f LEFT JOIN m ON m.sample = s.sample AND m.feature = f.feature)
SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS cor FROM dense a JOIN md b ON a.sample = b.sample GROUP BY 1, 2""")
def correlation_between(spark, sf_dir):
    return D.rounded(P.pearson_between(D.expr(spark, sf_dir), _classes(spark, sf_dir), _n(spark, sf_dir)), "cor")


@query(f"{_D} SELECT a.feature AS f1, b.feature AS f2, round(covar_samp(a.value, b.value) / sqrt(var_samp(a.value) * var_samp(b.value)), 6) AS cor {_PAIR}")
def covariance_to_correlation(spark, sf_dir):
    e, n = D.expr(spark, sf_dir), _n(spark, sf_dir)
    return D.rounded(P.correlation_of_covariance(P.covariance(e, n), P.variances(e, n)), "cor")


def _neighbouring(spark, sf_dir):
    """Parts with the next part."""
    k = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("f1"))
    return k.select("f1", (F.col("f1") + 1).alias("f2"))


@query(f"""WITH {D.NORM}, n AS (SELECT count(*) AS n FROM customer), m AS (SELECT gene, sum(norm) AS s, sum(norm * norm) AS q FROM norm GROUP BY 1), x AS (SELECT a.gene AS f1, b.gene AS f2, sum(a.norm * b.norm) AS xy FROM norm a JOIN norm b ON a.cell = b.cell AND b.gene = a.gene + 1 GROUP BY 1, 2)
SELECT a.gene AS f1, b.gene AS f2, round((coalesce(xy, 0) - a.s * b.s / n) / sqrt((a.q - a.s * a.s / n) * (b.q - b.s * b.s / n)), 6) AS cor FROM m a JOIN m b ON b.gene = a.gene + 1 CROSS JOIN n LEFT JOIN x ON x.f1 = a.gene AND x.f2 = b.gene""")
def gene_pair_correlations(spark, sf_dir):
    from helixframe.operators.cells import normalised

    norm = normalised(D.counts(spark, sf_dir)).select(F.col("cell").alias("sample"), F.col("gene").alias("feature"), F.col("norm").alias("value"))
    return D.rounded(P.pearson_of_pairs(norm, _neighbouring(spark, sf_dir), D.obs(spark, sf_dir).count()), "cor")


@query(f"{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS cor {_PAIR}), d AS (SELECT f1, f2, cor FROM c UNION ALL SELECT DISTINCT feature, feature, 1.0 FROM dense) SELECT f1, f2, round(cor, 6) AS cor FROM d WHERE abs(cor) >= 0.1")
def upper_triangle_table(spark, sf_dir):
    c = P.mirrored(P.pearson(D.expr(spark, sf_dir)), "cor")
    return D.rounded(P.upper_triangle(c, "cor", diagonal=1.0, least=0.1), "cor")


@query("""WITH a AS (SELECT o_custkey AS id, list(DISTINCT l_partkey % 100) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 25 GROUP BY 1), b AS (SELECT o_custkey AS id, list(DISTINCT l_partkey % 100) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 25 GROUP BY 1)
SELECT id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM a JOIN b USING (id)""")
def row_jaccard(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem").join(D.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), (F.col("l_partkey") % 100).alias("item"), (F.col("l_quantity") < 25).alias("few"))
    of = lambda c: li.filter(c).groupBy("id").agg(F.collect_set("item").alias("items"))
    return D.rounded(P.row_jaccard(of(F.col("few")), of(~F.col("few"))), "similarity")


@query(f"""{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, 1 - abs(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value))) AS d {_PAIR}), g AS (SELECT f1, f2, e, exp(-pow(d * e, 2)) AS a FROM c CROSS JOIN (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS e))
SELECT e AS epsilon, f AS feature, round(sum(a), 5) AS k FROM (SELECT e, f1 AS f, a FROM g UNION ALL SELECT e, f2, a FROM g) GROUP BY 1, 2""")
def connectivity_by_epsilon(spark, sf_dir):
    d = P.cosine_distance(D.expr(spark, sf_dir))
    return D.rounded(P.connectivity_by_epsilon(d, "distance", [0.25, 0.5, 1, 2, 4]), "k", digits=5)


_SIMS = f"WITH {D.SETS}, z AS (SELECT set_id, count(*) AS n FROM sets GROUP BY 1), j AS (SELECT x.set_id AS l, y.set_id AS r, count(*) AS shared FROM sets x JOIN sets y ON x.member = y.member AND x.set_id < y.set_id GROUP BY 1, 2), s AS (SELECT l, r, shared / (x.n + y.n - shared) AS similarity FROM j JOIN z x ON x.set_id = l JOIN z y ON y.set_id = r), c AS (SELECT quantile_cont(similarity, 0.95) AS critical FROM (SELECT similarity FROM s ORDER BY md5(concat_ws('|', l, r, 42)), l, r LIMIT 500))"


def _similarities(spark, sf_dir):
    s = D.sets(spark, sf_dir)
    return P.set_similarity(s, s).filter("l < r").select("l", "r", "similarity")


@query(f"{_SIMS} SELECT round(critical, 6) AS critical FROM c")
def critical_value(spark, sf_dir):
    return D.rounded(P.critical_value(_similarities(spark, sf_dir), "similarity", ["l", "r"], draws=500), "critical")


@query(f"{_SIMS} SELECT l, r, round(similarity, 6) AS similarity, round(critical, 6) AS critical FROM s CROSS JOIN c WHERE similarity >= critical")
def similarities_above_critical(spark, sf_dir):
    return D.rounded(P.above_critical(_similarities(spark, sf_dir), "similarity", ["l", "r"], draws=500), "similarity", "critical")


@query(f"""{_D}, m AS (SELECT CASE WHEN sample % 2 = 0 THEN 'even' ELSE 'odd' END AS origin, feature AS set_id, sample // 2 AS feature, value FROM dense), s AS (SELECT a.set_id AS ma, b.set_id AS mb, abs(corr(a.value, b.value)) AS similarity FROM m a JOIN m b ON a.feature = b.feature AND a.origin = 'even' AND b.origin = 'odd' GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY ma ORDER BY round(similarity, 9) DESC) AS r1, rank() OVER (PARTITION BY mb ORDER BY round(similarity, 9) DESC) AS r2 FROM s WHERE similarity >= 0.01) SELECT 'even' AS origin_a, ma AS module_a, 'odd' AS origin_b, mb AS module_b, round(similarity, 6) AS similarity FROM r WHERE r1 = 1 AND r2 = 1""")
def correlated_best_hits(spark, sf_dir):
    """Loadings of brands over customers with even and with odd numbers."""
    d = _dense(spark, sf_dir).select(F.when(F.col("sample") % 2 == 0, "even").otherwise("odd").alias("origin"), F.col("feature").alias("set_id"), F.floor(F.col("sample") / 2).alias("feature"), "value")
    return D.rounded(P.correlated_best_hits(d, 0.01), "similarity")


def _modules(spark, sf_dir):
    """Brands by their last digit."""
    return D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), F.right("p_brand", F.lit(1)).alias("module")).distinct()


_MOD = f"{_D}, c AS (SELECT a.feature AS f1, b.feature AS f2, corr(a.value, b.value) AS cor {_PAIR}), mo AS (SELECT DISTINCT p_brand AS feature, right(p_brand, 1) AS module FROM part)"


@query(_MOD + """, s AS (SELECT f1, f2, cor FROM c UNION ALL SELECT f2, f1, cor FROM c), o AS (SELECT x.module, f1, f2, cor FROM s JOIN mo x ON x.feature = f1 JOIN mo y ON y.feature = f2 WHERE x.module = y.module), h AS (SELECT module, f1 AS hub, row_number() OVER (PARTITION BY module ORDER BY round(avg(abs(cor)), 9) DESC, f1) AS r FROM o GROUP BY 1, 2),
w AS (SELECT o.module, f1 AS feature, cor AS c FROM o JOIN h ON h.module = o.module AND r = 1 AND f2 = hub UNION ALL SELECT module, hub, 1.0 FROM h WHERE r = 1), mn AS (SELECT module, f1 AS feature, avg(cor) AS m FROM o GROUP BY 1, 2) SELECT module, feature, CASE WHEN c < 0 THEN -1 ELSE 1 END AS sign, round(m, 6) AS mean_cor FROM w LEFT JOIN mn USING (module, feature)""")
def modules_by_sign(spark, sf_dir):
    return D.rounded(P.split_by_sign(P.pearson(D.expr(spark, sf_dir)), _modules(spark, sf_dir)), "mean_cor")


@query(_MOD + ", o AS (SELECT x.module, cor * cor AS r2 FROM c JOIN mo x ON x.feature = f1 JOIN mo y ON y.feature = f2 WHERE x.module = y.module), q AS (SELECT module, quantile_cont(r2, 0.5) AS md, 1.4826 * mad(r2) AS mad FROM o GROUP BY 1) SELECT module, (SELECT count(*) FROM mo WHERE mo.module = q.module) AS size, round(md, 9) AS r2_median, round(mad, 9) AS r2_mad FROM q")
def module_quality(spark, sf_dir):
    return D.rounded(P.module_quality(P.pearson(D.expr(spark, sf_dir)), _modules(spark, sf_dir)), "r2_median", "r2_mad", digits=9)


@query("""WITH r AS (SELECT 1 AS run, p_partkey AS feature, p_brand AS cluster FROM part UNION ALL SELECT 2, p_partkey, p_type FROM part UNION ALL SELECT 3, p_partkey, 's' || p_size FROM part), z AS (SELECT run, cluster, count(*) AS n FROM r GROUP BY 1, 2),
b AS (SELECT a.feature, a.run AS ra, a.cluster AS ca, b.run AS rb, b.cluster AS cb, count(*) OVER (PARTITION BY a.run, a.cluster, b.run, b.cluster) AS shared FROM r a JOIN r b ON a.feature = b.feature AND a.run < b.run),
j AS (SELECT feature, shared / (x.n + y.n - shared) AS j FROM b JOIN z x ON x.run = ra AND x.cluster = ca JOIN z y ON y.run = rb AND y.cluster = cb) SELECT feature, round(avg(j), 6) AS mean_jaccard, round(coalesce(stddev_samp(j), 0), 6) AS sd_jaccard FROM j GROUP BY 1""")
def cluster_stability(spark, sf_dir):
    """Brand, type and size as three clusterings of parts."""
    p = D.table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("feature"), F.explode(F.array(F.struct(F.lit(1).alias("run"), F.col("p_brand").alias("cluster")), F.struct(F.lit(2).alias("run"), F.col("p_type").alias("cluster")), F.struct(F.lit(3).alias("run"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("cluster")))).alias("x")).select("feature", "x.*")
    return D.rounded(P.cluster_stability(r), "mean_jaccard", "sd_jaccard")


@query()
def correlation_modules(spark, sf_dir):
    """Modules of brands by the correlations of their pieces over customers."""
    found = T.correlation_modules(correlation_pearson(spark, sf_dir), k_max=30, junk=0.0)[0]
    return D.rounded(found, "r2")
