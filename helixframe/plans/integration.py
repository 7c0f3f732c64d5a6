"""Doublets, batches, communities and factors: customers as cells, and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from helixframe.operators import communities as C
from helixframe.operators import factors as X
from helixframe.operators import graphs as G
from helixframe.operators import integration as I
from helixframe.operators import trajectory as J
from helixframe.plans import data as D
from helixframe.plans.graphs import _V, knn, labels, vectors
from helixframe.plans.registry import query

_SIM = 1_000_000_000


def _undirected(spark, sf_dir):
    """Shared-neighbour graph of the embeddings."""
    return G.shared_neighbours(knn(spark, sf_dir)).select("src", "dst", "weight")


@query(f"""WITH {D.COUNTS}, n AS (SELECT count(*) AS n FROM customer), p AS (SELECT {_SIM} + c_custkey AS cell, unnest([c_custkey, (c_custkey * 31 + 7) % n + 1]) AS parent FROM customer CROSS JOIN n)
SELECT p.cell, gene, CAST(sum(raw) AS BIGINT) AS raw FROM p JOIN counts ON counts.cell = parent GROUP BY 1, 2""")
def simulated_doublets(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    pairs = c.select((key + _SIM).alias("cell"), key.alias("first"), ((key * 31 + 7) % c.count() + 1).alias("second"))
    return I.simulated_doublets(D.counts(spark, sf_dir), pairs)


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT {_SIM} + a.id AS id, list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] + b.e[i]) / 2) AS e FROM r a CROSS JOIN n JOIN r b ON b.id = (a.id * 31 + 7) % n),
v AS (SELECT * FROM r UNION ALL SELECT * FROM s), k AS (SELECT * FROM (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.e, b.e), 9), b.id) AS rank FROM r a JOIN v b ON a.id <> b.id) WHERE rank <= 10),
c AS (SELECT id, count(*) FILTER (neighbour >= {_SIM}) AS n_simulated, (count(*) FILTER (neighbour >= {_SIM}) + 1) / 12.0 AS q FROM k GROUP BY 1)
SELECT id, n_simulated, round(q * 0.06 / (1 - 0.06 - q * (1 - 0.06 - 0.06)), 6) AS score FROM c""")
def doublet_scores(spark, sf_dir):
    """As many simulated doublets as vectors, each the mean of two."""
    v = vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    other = v.select(F.col("id").alias("second"), F.col("embedding").alias("e2"))
    sim = v.join(other, F.col("second") == (F.col("id") * 31 + 7) % v.count()).select((F.col("id") + _SIM).alias("id"), F.zip_with("embedding", "e2", lambda a, b: (a + b) / 2).alias("embedding"))
    near = G.nearest_neighbours(v.unionByName(sim), 10, v)
    return D.rounded(I.doublet_scores(near, sim, rate=0.06, ratio=1.0), "score")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label < 5 AS ref FROM embeddings), d AS (SELECT a.id AS a, b.id AS b, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON b.ref AND NOT a.ref),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS ra, row_number() OVER (PARTITION BY b ORDER BY round(distance, 9), a) AS rb FROM d) SELECT a, b, round(distance, 6) AS distance FROM r WHERE ra <= 10 AND rb <= 10""")
def mutual_neighbours(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return D.rounded(I.mutual_neighbours(v.filter("label >= 5"), v.filter("label < 5"), 10), "distance")


@query()
def batch_matching(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return I.matched_batch(v.filter("label >= 5"), v.filter("label < 5"), 10).select("id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))


@query(f"{_V}, c AS (SELECT k.id, v.label, count(*) AS n FROM knn k JOIN v ON v.id = k.neighbour GROUP BY 1, 2), r AS (SELECT *, n / sum(n) OVER (PARTITION BY id) AS share, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM c) SELECT id, label, round(share, 6) AS share FROM r WHERE r = 1")
def label_transfer(spark, sf_dir):
    return D.rounded(I.transferred_labels(knn(spark, sf_dir), labels(spark, sf_dir)), "share")


@query(f"{_V.replace('WITH', f'WITH {D.COUNTS},', 1)}, h AS (SELECT knn.id AS meta, neighbour AS cell FROM knn JOIN v USING (id) WHERE label = 0 UNION SELECT id, id FROM v WHERE label = 0) SELECT meta, gene, CAST(sum(raw) AS BIGINT) AS raw FROM h JOIN counts USING (cell) GROUP BY 1, 2")
def meta_cells(spark, sf_dir):
    return I.meta_cells(D.counts(spark, sf_dir), knn(spark, sf_dir), labels(spark, sf_dir).filter("label = 0"))


@query(f"""WITH {D.EXPR}, e AS (SELECT sample, feature, value, c_mktsegment = 'MACHINERY' AS empty FROM expr JOIN customer ON c_custkey = sample), n AS (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY'),
f AS (SELECT feature, n, n - count(*) FILTER (empty) AS zeros, sum(ln(value + 10)) FILTER (empty) AS s FROM e CROSS JOIN n GROUP BY 1, 2), m AS (SELECT feature, n, zeros, (s + zeros * ln(10)) / n AS mean FROM f),
b AS (SELECT feature, mean, sqrt((sum(pow(ln(value + 10) - mean, 2)) FILTER (empty) + max(zeros) * pow(ln(10) - mean, 2)) / (max(n) - 1)) AS sd FROM e JOIN m USING (feature) GROUP BY 1, 2)
SELECT sample AS cell, feature AS gene, round((ln(value + 10) - mean) / sd, 5) AS value, round((ln(10) - mean) / sd, 5) AS at_zero FROM e JOIN b USING (feature) WHERE NOT empty""")
def background_scaled(spark, sf_dir):
    """Customers of one segment stand for the empty droplets."""
    c = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), (F.col("c_mktsegment") == "MACHINERY").alias("empty"))
    e = D.expr(spark, sf_dir).select(F.col("sample").alias("cell"), F.col("feature").alias("gene"), F.col("value").alias("raw")).join(c, "cell")
    return D.rounded(I.background_scaled(e.filter("not empty"), e.filter("empty"), c.filter("empty").count()), "value", "at_zero", digits=5)


@query(f"""{_V}, x AS (SELECT id AS cell, CAST(g - 1 AS INT) AS gene, e[g] AS value FROM v, range(1, len(v.e) + 1) t(g)), z AS (SELECT cell, gene, (value - avg(value) OVER (PARTITION BY gene)) / stddev_samp(value) OVER (PARTITION BY gene) AS z FROM x),
p AS (SELECT a.gene AS ga, b.gene AS gb, sum(a.z * b.z) AS s FROM knn JOIN z a ON a.cell = knn.id JOIN z b ON b.cell = knn.neighbour GROUP BY 1, 2) SELECT a.ga AS g1, a.gb AS g2, round((a.s + b.s) / 2, 4) AS cor FROM p a JOIN p b ON a.ga = b.gb AND a.gb = b.ga WHERE a.ga <= a.gb""")
def local_correlation(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.lit(1.0).alias("weight"))
    x = vectors(spark, sf_dir).select(F.col("id").alias("cell"), F.posexplode("embedding").alias("gene", "value"))
    return D.rounded(I.local_correlation(x, e, x.select("gene")), "cor", digits=4)


@query()
def louvain_communities(spark, sf_dir):
    return C.louvain(_undirected(spark, sf_dir))


#: Resolutions of the queries on communities.
RESOLUTIONS = (0.5, 1.0, 2.0)


@query()
def leiden_communities(spark, sf_dir):
    """Communities of the shared-neighbour graph at several resolutions."""
    return C.leiden(_undirected(spark, sf_dir), RESOLUTIONS)


@query()
def resolution_grid(spark, sf_dir):
    """Number, size and modularity of the communities of each resolution."""
    e = _undirected(spark, sf_dir)
    return D.rounded(C.resolution_summary(e, C.leiden(e, RESOLUTIONS)), "modularity")


def _polynomials(beta: float, order: int) -> str:
    """Chebyshev polynomials of the normalised adjacency, t0, t1, ..., and their sum."""
    c = np.polynomial.chebyshev.chebinterpolate(lambda x: np.exp(-beta * (1 - x)), order).tolist()
    out = ["t0 AS MATERIALIZED (SELECT id AS node, label, 1.0::DOUBLE AS value FROM v)"]
    for i in range(1, order + 1):
        before = f"UNION ALL SELECT node, label, -value FROM t{i - 2}" if i > 1 else ""
        out.append(f"t{i} AS MATERIALIZED (SELECT node, label, sum(value) AS value FROM (SELECT a.src AS node, label, {min(i, 2)} * a.w * value AS value FROM a JOIN t{i - 1} t ON t.node = a.dst {before}) GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT node, label, {x!r}::DOUBLE * value AS value FROM t{i}" for i, x in enumerate(c))
    return ", ".join(out) + f", sm AS (SELECT node, label, sum(value) AS value FROM ({every}) GROUP BY 1, 2)"


@query(f"""{_V}, own AS (SELECT id, neighbour FROM knn UNION SELECT id, id FROM v), n AS (SELECT id, count(*) AS n FROM own GROUP BY 1), sn AS (SELECT a.id AS src, b.id AS dst, count(*) AS shared FROM own a JOIN own b ON a.neighbour = b.neighbour AND a.id < b.id GROUP BY 1, 2),
e0 AS MATERIALIZED (SELECT src, dst, shared / (x.n + y.n - shared) AS w FROM sn JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE shared / (x.n + y.n - shared) >= 1.0 / 15), e AS MATERIALIZED (SELECT src, dst, w FROM e0 UNION ALL SELECT dst, src, w FROM e0), dg AS (SELECT src, sum(w) AS d FROM e GROUP BY 1),
a AS MATERIALIZED (SELECT e.src, e.dst, e.w / sqrt(x.d * y.d) AS w FROM e JOIN dg x ON x.src = e.src JOIN dg y ON y.src = e.dst), {_polynomials(2.0, 8)} SELECT node, label, round(value, 6) AS value FROM sm""")
def smoothed_density(spark, sf_dir):
    """Density of each label over the shared-neighbour graph."""
    s = labels(spark, sf_dir).select(F.col("id").alias("node"), "label", F.lit(1.0).alias("value"))
    return D.rounded(C.smoothed_signal(_undirected(spark, sf_dir), s, beta=2.0, order=8), "value")


@query()
def independent_components(spark, sf_dir):
    return X.independent_components(vectors(spark, sf_dir), 3, rounds=15).select("id", F.transform("ic", lambda x: F.round(x, 3)).alias("ic"))


@query()
def nonnegative_factors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float"))).alias("embedding"))
    return X.nonnegative_factors(v, 4, rounds=8)[0].select("id", F.transform("weights", lambda x: F.round(x, 4)).alias("weights"))


@query()
def restarted_factors(spark, sf_dir):
    """Of three starts the best."""
    v = vectors(spark, sf_dir).select("id", F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float"))).alias("embedding"))
    return X.restarted_factors(v, 4, runs=3, rounds=6)[0].select("id", F.transform("weights", lambda x: F.round(x, 4)).alias("weights"))


@query()
def singular_vectors(spark, sf_dir):
    return X.singular_vectors(vectors(spark, sf_dir), 5)[0].select("id", F.transform("u", lambda x: F.round(x, 5)).alias("u"))


@query()
def diffusion_components(spark, sf_dir):
    dc, _, _ = J.diffusion_map(knn(spark, sf_dir), 6, tolerance=1e-3)
    return dc.select("id", F.transform("dc", lambda x: F.round(x, 4)).alias("dc"))


@query()
def palantir_pseudotime(spark, sf_dir):
    """From the cell with the smallest id to those with the largest id of three labels."""
    found = labels(spark, sf_dir).groupBy("label").agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("label").collect()
    told, _ = J.palantir(knn(spark, sf_dir), min(r["low"] for r in found), [r["high"] for r in found[1:4]])
    return D.rounded(told, "pseudotime", "entropy", digits=4).withColumn("fates", F.transform("fates", lambda x: F.round(x, 4)))
