"""Graphs: suppliers and the nations they ship to, and nearest neighbours of embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.ranks import weighted_bh
from helixframe.operators import communities as C
from helixframe.operators import graphs as G
from helixframe.operators import layout as L
from helixframe.operators import neighbours as N
from helixframe.plans import data as D
from helixframe.plans.registry import query
from helixframe.session import written

_V = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), d AS (SELECT a.id, b.id AS neighbour, round(list_distance(a.e, b.e), 6) AS d6, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id), knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), neighbour) AS rank FROM d) WHERE rank <= 10)"


def vectors(spark, sf_dir):
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def labels(spark, sf_dir):
    return D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def knn(spark, sf_dir):
    """Exact, as SQL of the same rows is exact; the other ways have queries of their own. Written once, since plans read it
    several times and would search each time."""
    return written(N.neighbours(vectors(spark, sf_dir), 10, method="exact"))


def edges(spark, sf_dir):
    """Suppliers and nations of customers, weighted by shipments."""
    li = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o, c = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.col("l_suppkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


@query(f"{_V} SELECT id, neighbour, d6 AS distance, CAST(rank AS INT) AS rank FROM knn")
def nearest_neighbours(spark, sf_dir):
    return D.rounded(knn(spark, sf_dir), "distance")


@query(f"""{_V}, own AS (SELECT id, neighbour FROM knn UNION SELECT id, id FROM v), n AS (SELECT id, count(*) AS n FROM own GROUP BY 1), s AS (SELECT a.id AS src, b.id AS dst, count(*) AS shared FROM own a JOIN own b ON a.neighbour = b.neighbour AND a.id < b.id GROUP BY 1, 2)
SELECT src, dst, shared, round(shared / (x.n + y.n - shared), 6) AS weight FROM s JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE shared / (x.n + y.n - shared) >= 1.0 / 15""")
def shared_neighbours(spark, sf_dir):
    return D.rounded(G.shared_neighbours(knn(spark, sf_dir)), "weight")


@query(f"{_V}, c AS (SELECT k.id, v.label, count(*) AS c FROM knn k JOIN v ON v.id = k.neighbour GROUP BY 1, 2), p AS (SELECT id, c / sum(c) OVER (PARTITION BY id) AS p FROM c) SELECT id, round(1 / sum(p * p), 6) AS lisi FROM p GROUP BY 1")
def batch_lisi(spark, sf_dir):
    return D.rounded(G.inverse_simpson(knn(spark, sf_dir), labels(spark, sf_dir)), "lisi")


@query(f"""{_V}, g AS (SELECT label, count(*) / sum(count(*)) OVER () AS share FROM v GROUP BY 1), x AS (SELECT k.id, g.label, max(g.share) * 10 AS e, count(*) FILTER (v.label = g.label) AS c FROM knn k JOIN v ON v.id = k.neighbour CROSS JOIN g GROUP BY 1, 2)
SELECT id, round(sum(pow(c - e, 2) / e), 6) AS chi2, count(*) - 1 AS df FROM x GROUP BY 1""")
def batch_kbet(spark, sf_dir):
    return D.rounded(G.batch_chi_square(knn(spark, sf_dir), labels(spark, sf_dir)), "chi2")


@query(f"""{_V}, e AS (SELECT a.label AS l1, b.label AS l2 FROM knn k JOIN v a ON a.id = k.id JOIN v b ON b.id = k.neighbour), o AS (SELECT l1, count(*) AS e FROM e GROUP BY 1), s AS (SELECT label, count(*) AS n FROM v GROUP BY 1),
c AS (SELECT least(l1, l2) AS c1, greatest(l1, l2) AS c2, count(*) AS n_edges FROM e WHERE l1 <> l2 GROUP BY 1, 2),
x AS (SELECT c1, c2, n_edges, (o1.e * s2.n + o2.e * s1.n) / ((SELECT count(*) FROM v) - 1) AS expected FROM c JOIN o o1 ON o1.l1 = c1 JOIN o o2 ON o2.l1 = c2 JOIN s s1 ON s1.label = c1 JOIN s s2 ON s2.label = c2)
SELECT c1, c2, n_edges, round(expected, 6) AS expected, round(least(1.0, n_edges / expected), 6) AS connectivity FROM x""")
def cluster_connectivity(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    return D.rounded(G.cluster_connectivity(e, labels(spark, sf_dir)), "expected", "connectivity")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), d AS (SELECT a.id, a.label AS own, b.label, sum(pow(list_distance(a.e, b.e), 2)) AS d, count(*) AS n FROM v a CROSS JOIN v b GROUP BY 1, 2, 3),
w AS (SELECT id, max(d / nullif(n - 1, 0)) FILTER (own = label) AS a, min(d / n) FILTER (own <> label) AS b FROM d GROUP BY 1) SELECT id, round(a, 5) AS a, round(b, 5) AS b, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 5) AS width FROM w""")
def silhouette_width(spark, sf_dir):
    return D.rounded(G.silhouette(vectors(spark, sf_dir), labels(spark, sf_dir)), "a", "b", "width", digits=5)


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 3 AS batch FROM embeddings), d AS (SELECT a.id, b.id AS neighbour, b.batch, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id, batch ORDER BY round(distance, 9), neighbour) AS rank FROM d)
SELECT id, neighbour, round(distance, 6) AS distance, CAST(rank AS INT) AS rank, batch FROM r WHERE rank <= 3""")
def batch_balanced_neighbours(spark, sf_dir):
    b = vectors(spark, sf_dir).select("id", (F.col("id") % 3).alias("label"))
    return D.rounded(G.batch_balanced_neighbours(vectors(spark, sf_dir), b, 3), "distance")


@query(f"{_V}, h AS (SELECT id, neighbour AS cell FROM knn UNION ALL SELECT id, id FROM v) SELECT h.id AS nhood, v.label AS sample, count(*) AS n FROM h JOIN v ON v.id = h.cell GROUP BY 1, 2")
def neighbourhood_counts(spark, sf_dir):
    return G.neighbourhood_counts(knn(spark, sf_dir), vectors(spark, sf_dir), labels(spark, sf_dir))


@query(f"""{_V}, p AS (SELECT id, round(max(d6), 6) AS kth, (id * 37 % 101) / 101.0 AS pvalue FROM knn GROUP BY 1), w AS (SELECT id, pvalue, CASE WHEN kth = 0 THEN 1.0 ELSE 1 / kth END AS weight FROM p),
r AS (SELECT *, sum(weight) OVER () * pvalue / sum(weight) OVER (ORDER BY pvalue, id ROWS UNBOUNDED PRECEDING) AS raw FROM w)
SELECT id, round(pvalue, 6) AS pvalue, round(weight, 5) AS weight, round(least(1.0, min(raw) OVER (ORDER BY pvalue DESC, id DESC ROWS UNBOUNDED PRECEDING)), 5) AS spatial_fdr FROM r""")
def spatial_fdr(spark, sf_dir):
    k = D.rounded(knn(spark, sf_dir), "distance").groupBy("id").agg(F.max("distance").alias("kth"))
    p = k.select("id", ((F.col("id") * 37 % 101) / 101).alias("pvalue"), F.coalesce(1 / F.nullif("kth", F.lit(0.0)), F.lit(1.0)).alias("weight"))
    return D.rounded(D.rounded(weighted_bh(p), "pvalue"), "weight", "spatial_fdr", digits=5)


_EDGES = "e0 AS MATERIALIZED (SELECT l_suppkey AS src, CAST(-1 - c_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), e AS MATERIALIZED (SELECT src, dst, weight FROM e0 UNION ALL SELECT dst, src, weight FROM e0), w AS MATERIALIZED (SELECT src, dst, 0.85 * weight / sum(weight) OVER (PARTITION BY src) AS weight FROM e)"
#: Flow after k steps, added up over all steps.
_FLOW = "t(side, node, score, k) AS (SELECT side, node, CAST(score AS DOUBLE), 0 FROM p UNION ALL SELECT side, dst, sum(score * weight), k + 1 FROM t JOIN w ON node = src WHERE k < 180 GROUP BY side, dst, k), x AS (SELECT side, node, sum(score) AS s FROM t GROUP BY 1, 2), r AS (SELECT side, node, s / sum(s) OVER (PARTITION BY side) AS score FROM x)"


def _suppliers(spark, sf_dir):
    return D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal", F.lit(1.0).alias("score"))


@query(f"WITH RECURSIVE {_EDGES}, p AS (SELECT 'a' AS side, s_suppkey AS node, 1.0 / count(*) OVER () AS score FROM supplier WHERE s_acctbal > 5000), {_FLOW} SELECT node, round(score, 6) AS score FROM r")
def page_rank(spark, sf_dir):
    seeds = _suppliers(spark, sf_dir).filter("s_acctbal > 5000").select("node", "score")
    return D.rounded(G.personalised_page_rank(G.both_ways(edges(spark, sf_dir)), seeds), "score")


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT 'a' AS side, s_suppkey AS node, 1.0 / count(*) OVER () AS score FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'b', s_suppkey, 1.0 / count(*) OVER () FROM supplier WHERE s_acctbal <= 0), {_FLOW}
SELECT node, round(least(coalesce(max(score) FILTER (side = 'a'), 0), coalesce(max(score) FILTER (side = 'b'), 0)), 6) AS score FROM r GROUP BY 1""")
def tied_diffusion(spark, sf_dir):
    s = _suppliers(spark, sf_dir)
    return D.rounded(G.tied_diffusion(G.both_ways(edges(spark, sf_dir)), s.filter("s_acctbal > 5000"), s.filter("s_acctbal <= 0")), "score")


@query(f"""WITH RECURSIVE {_EDGES}, dg AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY 1), bn AS (SELECT node, ntile(4) OVER (ORDER BY degree, node) AS bin FROM dg), pl AS (SELECT bin, node, row_number() OVER (PARTITION BY bin ORDER BY node) AS pos FROM bn),
sd AS (SELECT node, 1.0 AS score FROM supplier JOIN dg ON node = s_suppkey WHERE s_acctbal > 5000), hd AS (SELECT bin, pos, score FROM pl JOIN sd USING (node)),
dr AS (SELECT bin, node, perm, row_number() OVER (PARTITION BY perm, bin ORDER BY md5(concat_ws('|', node, perm, 42))) AS pos FROM pl CROSS JOIN range(1, 6) t(perm)),
p0 AS (SELECT perm AS side, node, score FROM dr JOIN hd USING (bin, pos) UNION ALL SELECT 0, s_suppkey, 1.0 FROM supplier WHERE s_acctbal > 5000), p AS (SELECT side, node, score / sum(score) OVER (PARTITION BY side) AS score FROM p0), {_FLOW},
g AS (SELECT node, max(score) FILTER (side = 0) AS score, coalesce(sum(score) FILTER (side > 0), 0) / 5 AS mean, coalesce(sum(score * score) FILTER (side > 0), 0) AS q FROM r GROUP BY 1)
SELECT node, round(score, 6) AS score, round(mean, 6) AS mean, round(sqrt(greatest(0, (q - 5 * mean * mean) / 4)), 6) AS sd FROM g WHERE score IS NOT NULL""")
def diffusion_permutations(spark, sf_dir):
    """Five permutations within four bins of degree."""
    seeds = _suppliers(spark, sf_dir).filter("s_acctbal > 5000").select("node", "score")
    return D.rounded(G.diffusion_significance(G.both_ways(edges(spark, sf_dir)), seeds, 5, 4), "score", "mean", "sd").drop("z")


@query("WITH n AS (SELECT DISTINCT l_suppkey AS node FROM lineitem), w AS (SELECT s_suppkey AS node, s_acctbal AS weight FROM supplier WHERE s_acctbal > 5000), h AS (SELECT node, coalesce(weight, 0) AS weight FROM n LEFT JOIN w USING (node)) SELECT node, round(weight / sum(weight) OVER (), 9) AS score FROM h")
def personalisation_vector(spark, sf_dir):
    nodes = D.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"))
    w = D.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("weight"))
    return D.rounded(G.personalisation(nodes, w), "score", digits=9)


def _spread(rounds: int) -> str:
    """The rounds of label propagation as tables s0, s1, ..."""
    steps = ["s0 AS MATERIALIZED (SELECT id AS node, label, 1.0::DOUBLE AS p FROM v WHERE id % 4 = 0)"]
    for i in range(1, rounds + 1):
        steps.append(f"m{i} AS (SELECT node, label, sum(p) AS p FROM (SELECT k.id AS node, s.label, 0.9 * s.p / c.n AS p FROM knn k JOIN s{i - 1} s ON s.node = k.neighbour JOIN deg c ON c.id = k.id UNION ALL SELECT node, label, 0.1 * p FROM s0) GROUP BY 1, 2), s{i} AS MATERIALIZED (SELECT node, label, p / sum(p) OVER (PARTITION BY node) AS p FROM m{i})")
    return ", ".join(steps)


_VM = _V.replace("knn AS (", "knn AS MATERIALIZED (")


@query(f"{_VM}, deg AS (SELECT id, count(*) AS n FROM knn GROUP BY 1), {_spread(10)} SELECT node, label, round(p, 6) AS p FROM s10")
def label_propagation(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("neighbour").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    seeds = labels(spark, sf_dir).filter("id % 4 = 0").withColumnRenamed("id", "node")
    return D.rounded(G.label_propagation(e, seeds), "p")


def _averaged(steps: int) -> str:
    t = "t AS MATERIALIZED (SELECT id, neighbour, 1 / (1 + distance) / sum(1 / (1 + distance)) OVER (PARTITION BY id) AS w FROM knn), x0 AS MATERIALIZED (SELECT id AS cell, CAST(g - 1 AS INT) AS gene, e[g] AS value FROM v, range(1, len(v.e) + 1) r(g))"
    return ", ".join([t, *(f"x{i} AS MATERIALIZED (SELECT t.id AS cell, gene, sum(w * value) AS value FROM t JOIN x{i - 1} ON cell = neighbour GROUP BY 1, 2)" for i in range(1, steps + 1))])


@query(f"{_VM}, {_averaged(3)} SELECT cell, gene, round(value, 5) AS value FROM x3")
def magic_imputation(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), (1 / (1 + F.col("distance"))).alias("weight"))
    x = vectors(spark, sf_dir).select(F.col("id").alias("cell"), F.posexplode("embedding").alias("gene", "norm"))
    return D.rounded(G.imputed(x, e), "value", digits=5)


@query(f"""{_VM}, x AS (SELECT id AS cell, CAST(g - 1 AS INT) AS gene, e[g] AS value FROM v, range(1, len(v.e) + 1) r(g)), z AS MATERIALIZED (SELECT cell, gene, (value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene) AS z FROM x)
SELECT a.gene, round(sum(a.z * b.z), 4) AS g, count(*) AS n FROM knn k JOIN z a ON a.cell = k.id JOIN z b ON b.cell = k.neighbour AND b.gene = a.gene GROUP BY 1""")
def local_autocorrelation(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.lit(1.0).alias("weight"))
    x = vectors(spark, sf_dir).select(F.col("id").alias("cell"), F.posexplode("embedding").alias("gene", "value"))
    return D.rounded(G.local_autocorrelation(x, e), "g", digits=4)


@query()
def approximate_neighbours(spark, sf_dir):
    return D.rounded(N.neighbours(vectors(spark, sf_dir), 10, method="lists"), "distance")


@query()
def descended_neighbours(spark, sf_dir):
    return D.rounded(N.neighbours(vectors(spark, sf_dir), 10, method="descent"), "distance")


@query(f"""{_V}, f AS (SELECT id, neighbour, distance FROM knn WHERE rank % 3 <> 0), k AS (SELECT id, count(*) AS k, avg(distance) AS d0 FROM knn GROUP BY 1), h AS (SELECT id, count(*) AS hit, avg(distance) AS d1 FROM f GROUP BY 1)
SELECT id, round(coalesce(hit, 0) / k, 6) AS recall, round(d1 / nullif(d0, 0), 6) AS distance_ratio FROM k LEFT JOIN h USING (id)""")
def neighbour_recall(spark, sf_dir):
    """Every third neighbour taken away."""
    k = knn(spark, sf_dir)
    return D.rounded(G.neighbour_recall(k, k.filter("rank % 3 <> 0")), "recall", "distance_ratio")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 3 AS batch FROM embeddings), d AS (SELECT a.id, b.id AS neighbour, b.batch, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id, batch ORDER BY round(distance, 9), neighbour) AS rk FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), neighbour) AS rank FROM r WHERE rk <= 3) SELECT id, neighbour, round(distance, 6) AS distance, CAST(rank AS INT) AS rank, batch FROM t WHERE rank <= 5""")
def batch_balanced_nearest(spark, sf_dir):
    b = vectors(spark, sf_dir).select("id", (F.col("id") % 3).alias("label"))
    return D.rounded(G.nearest_of_all(G.batch_balanced_neighbours(vectors(spark, sf_dir), b, 3), 5), "distance")


@query()
def principal_components(spark, sf_dir):
    return G.principal_components(vectors(spark, sf_dir), 5).select("id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query()
def contrastive_components(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return G.contrastive_components(v.filter("label < 5"), v.filter("label >= 5"), 1.0, 3).select("id", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query(f"""{_V.replace("WITH", "WITH RECURSIVE", 1)}, r AS (SELECT id, list(distance ORDER BY distance) AS d, coalesce(min(distance) FILTER (distance > 0), 0) AS rho, avg(distance) AS mean FROM knn GROUP BY 1),
s AS (SELECT id, d, rho, mean, 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(-1 AS DOUBLE) AS high, CAST(1 AS DOUBLE) AS mid FROM r
UNION ALL SELECT id, d, rho, mean, i + 1, CASE WHEN t > log2(len(d) + 1) THEN low ELSE mid END, CASE WHEN t > log2(len(d) + 1) THEN mid ELSE high END, CASE WHEN t > log2(len(d) + 1) THEN (low + mid) / 2 WHEN high < 0 THEN mid * 2 ELSE (mid + high) / 2 END
FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / mid))) AS t FROM s WHERE i < 64)),
w AS (SELECT knn.id AS src, neighbour AS dst, exp(-greatest(distance - rho, 0) / greatest(mid, mean / 1000)) AS w FROM knn JOIN s ON s.id = knn.id AND i = 64), b AS (SELECT * FROM w UNION ALL SELECT dst, src, w FROM w)
SELECT src, dst, round(sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END, 6) AS weight FROM b GROUP BY 1, 2""")
def fuzzy_neighbour_graph(spark, sf_dir):
    return D.rounded(L.fuzzy_graph(knn(spark, sf_dir)), "weight")


@query()
def umap_layout(spark, sf_dir):
    """Two dimensions of the embeddings, from a spectral start."""
    g = written(L.fuzzy_graph(knn(spark, sf_dir)))
    at = L.umap(g, L.spectral_start(g, 2, tolerance=1e-2, most=4))
    return at.select("id", F.col("at")[0].alias("umap_1"), F.col("at")[1].alias("umap_2"))


@query()
def privileged_communities(spark, sf_dir):
    """Suppliers and nations that a diffusion from ten suppliers reaches best."""
    e = G.both_ways(edges(spark, sf_dir))
    seeds = D.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.lit(1.0).alias("score")).filter("node <= 10")
    return C.privileged_communities(edges(spark, sf_dir), G.personalised_page_rank(e, seeds), seeds, resolution=1.0, min_nodes=5, max_nodes=50, min_seeds=1, most=10)
