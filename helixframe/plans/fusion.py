"""Networks of nations from two kinds of data, corrected embeddings, and components of expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import cells as C
from helixframe.operators import canonical as K
from helixframe.operators import fusion as U
from helixframe.operators import graphs as G
from helixframe.operators import harmonise as H
from helixframe.operators import integration as I
from helixframe.plans import data as D
from helixframe.plans.graphs import labels, vectors
from helixframe.plans.registry import query


def _numbers(spark, sf_dir):
    """sample = nation, feature = segment, value = mean balance."""
    c = D.table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("sample"), F.col("c_mktsegment").alias("feature")).agg(F.round(F.avg("c_acctbal") / 1000, 6).alias("value"))


def _kinds(spark, sf_dir):
    """sample = nation, feature = last digit of the customer, value = first segment by name."""
    c = D.table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("sample"), (F.col("c_custkey") % 10).alias("feature")).agg(F.min("c_mktsegment").alias("value"))


_NUM = "nu AS (SELECT c_nationkey AS sample, c_mktsegment AS feature, round(avg(c_acctbal) / 1000, 6) AS value FROM customer GROUP BY 1, 2), dn AS MATERIALIZED (SELECT a.sample AS a, b.sample AS b, sqrt(sum(pow(a.value - b.value, 2))) AS distance FROM nu a JOIN nu b ON a.feature = b.feature AND a.sample <> b.sample GROUP BY 1, 2)"
_CAT = "ca AS (SELECT c_nationkey AS sample, c_custkey % 10 AS feature, min(c_mktsegment) AS value FROM customer GROUP BY 1, 2), dc AS MATERIALIZED (SELECT a.sample AS a, b.sample AS b, avg(CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END) AS distance FROM ca a JOIN ca b ON a.feature = b.feature AND a.sample <> b.sample GROUP BY 1, 2)"


def _affinity(d: str, w: str) -> str:
    return f"""m{w} AS (SELECT a, avg(distance) AS m FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(distance, 9), b) AS r FROM {d}) WHERE r <= 8 GROUP BY 1),
{w} AS MATERIALIZED (SELECT {d}.a, {d}.b, coalesce(exp(-pow(distance, 2) / nullif(0.5 * (x.m + y.m + distance) / 3, 0)), 1.0) AS weight FROM {d} JOIN m{w} x ON x.a = {d}.a JOIN m{w} y ON y.a = {d}.b)"""


@query(f"WITH {_NUM}, {_affinity('dn', 'wn')} SELECT a, b, round(weight, 6) AS weight FROM wn")
def affinity_of_numbers(spark, sf_dir):
    return D.rounded(U.scaled_affinity(U.sample_distances(_numbers(spark, sf_dir)), 8), "weight")


@query(f"WITH {_CAT}, {_affinity('dc', 'wc')} SELECT a, b, round(weight, 6) AS weight FROM wc")
def affinity_of_categories(spark, sf_dir):
    return D.rounded(U.scaled_affinity(U.sample_distances(None, _kinds(spark, sf_dir)), 8), "weight")


@query(f"""WITH {_NUM}, {_CAT}, rg AS (SELECT feature, nullif(max(value) - min(value), 0) AS reach FROM nu GROUP BY 1), dd AS (SELECT a.sample AS a, b.sample AS b, coalesce(abs(a.value - b.value) / reach, 0) AS d FROM nu a JOIN nu b ON a.feature = b.feature AND a.sample <> b.sample JOIN rg ON rg.feature = a.feature
UNION ALL SELECT a.sample, b.sample, CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END FROM ca a JOIN ca b ON a.feature = b.feature AND a.sample <> b.sample), dm AS MATERIALIZED (SELECT a, b, avg(d) AS distance FROM dd GROUP BY 1, 2), {_affinity('dm', 'wm')} SELECT a, b, round(weight, 6) AS weight FROM wm""")
def affinity_of_mixed(spark, sf_dir):
    return D.rounded(U.scaled_affinity(U.sample_distances(_numbers(spark, sf_dir), _kinds(spark, sf_dir)), 8), "weight")


def _rounds(n: int) -> str:
    out = []
    for w, x in (("wn", "n"), ("wc", "c")):
        out.append(f"f{x}0 AS MATERIALIZED (SELECT a, b, coalesce(weight / nullif(2 * sum(weight) OVER (PARTITION BY a), 0), 0) AS weight FROM {w} UNION ALL SELECT DISTINCT a, a, 0.5 FROM {w})")
        out.append(f"l{x} AS MATERIALIZED (SELECT a, b, weight / nullif(sum(weight) OVER (PARTITION BY a), 0) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(weight, 12) DESC, b) AS r FROM {w}) WHERE r <= 8)")
    for i in range(1, n + 1):
        for x, y in (("n", "c"), ("c", "n")):
            out.append(f"q{x}{i} AS MATERIALIZED (SELECT s.a AS x, p.b AS v, sum(s.weight * p.weight) AS q FROM l{x} s JOIN f{y}{i - 1} p ON p.a = s.b GROUP BY 1, 2)")
            out.append(f"b{x}{i} AS (SELECT q.x, s.a AS y, sum(q * s.weight) AS w FROM q{x}{i} q JOIN l{x} s ON s.b = q.v GROUP BY 1, 2)")
            out.append(f"e{x}{i} AS MATERIALIZED (SELECT a, b, sum(w) / 2 AS weight FROM (SELECT x AS a, y AS b, w FROM b{x}{i} UNION ALL SELECT y, x, w FROM b{x}{i}) WHERE a <> b GROUP BY 1, 2)")
            out.append(f"f{x}{i} AS MATERIALIZED (SELECT a, b, coalesce(weight / nullif(2 * sum(weight) OVER (PARTITION BY a), 0), 0) AS weight FROM e{x}{i} UNION ALL SELECT DISTINCT a, a, 0.5 FROM e{x}{i})")
    return ", ".join(out)


@query(f"WITH {_NUM}, {_CAT}, {_affinity('dn', 'wn')}, {_affinity('dc', 'wc')}, {_rounds(4)} SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(weight) / 4, 7) AS weight FROM (SELECT * FROM fn4 UNION ALL SELECT * FROM fc4) WHERE a <> b GROUP BY 1, 2")
def fused_network(spark, sf_dir):
    """Four rounds."""
    ws = [U.scaled_affinity(d, 8) for d in (U.sample_distances(_numbers(spark, sf_dir)), U.sample_distances(None, _kinds(spark, sf_dir)))]
    return D.rounded(U.fused_network(ws, 8, 4), "weight", digits=7)


def _halves(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    n = F.size("embedding")
    return v.select("id", F.slice("embedding", F.lit(1), F.floor(n / 2).cast("int")).alias("embedding")), v.select("id", F.slice("embedding", F.floor(n / 2).cast("int") + 1, n).alias("embedding"))


@query()
def weighted_neighbours(spark, sf_dir):
    """Both halves of the embeddings as two kinds of data."""
    a, b = _halves(spark, sf_dir)
    return D.rounded(U.weighted_neighbours(a, b, G.nearest_neighbours(a, 10), G.nearest_neighbours(b, 10), 10), "weight", "share_first")


def _shown(df):
    return df.select("id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


@query()
def harmony_embedding(spark, sf_dir):
    b = vectors(spark, sf_dir).select("id", (F.col("id") % 3).alias("label"))
    return _shown(H.harmony(vectors(spark, sf_dir), b, clusters=10))


@query()
def harmony_adaptive_embedding(spark, sf_dir):
    b = vectors(spark, sf_dir).select("id", (F.col("id") % 3).alias("label"))
    return _shown(H.harmony(vectors(spark, sf_dir), b, clusters=10, ridge=None))


@query()
def mapped_query(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return _shown(H.map_query(v.filter("id % 2 = 1"), H.build_reference(v.filter("id % 2 = 0"), 10)))


@query()
def transferred_reference_labels(spark, sf_dir):
    """Labels of the reference carried over to a mapped query by its nearest neighbours."""
    ref, q = vectors(spark, sf_dir).filter("id % 2 = 0"), vectors(spark, sf_dir).filter("id % 2 = 1")
    moved = H.map_query(q, H.build_reference(ref, 10))
    base = ref.withColumn("embedding", F.col("embedding").cast("array<double>"))
    near = G.nearest_neighbours(base, 10, moved)
    return D.rounded(I.transferred_labels(near, labels(spark, sf_dir)), "share")


@query()
def projected_anchors(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return D.rounded(H.projected_anchors(v.filter("label >= 5"), v.filter("label < 5"), 10), "distance", digits=4)


@query()
def expression_components(spark, sf_dir):
    """Of the 200 most variable parts."""
    counts, n = D.counts(spark, sf_dir), D.obs(spark, sf_dir).count()
    genes = C.dispersion_hvg(counts, n, 200).filter("is_hvg").select("gene")
    return H.expression_components(C.normalised(counts), genes, n, 5).select("cell", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


@query()
def protein_components(spark, sf_dir):
    """Centred log ratios of brands."""
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.expr("cast(substring(p_brand, 7) as long)").alias("brand"))
    c = D.counts(spark, sf_dir).join(p, "gene").groupBy("cell", F.col("brand").alias("gene")).agg(F.sum("raw").alias("raw"))
    every = c.select("cell").distinct().join(c.select("gene").distinct())  # 25 brands a customer, those not bought with 0
    c = every.join(c, ["cell", "gene"], "left").withColumn("raw", F.coalesce("raw", F.lit(0)))
    x = C.clr(c, 25).select("cell", "gene", F.col("clr").alias("norm"))
    return H.expression_components(x, c.select("gene"), D.obs(spark, sf_dir).count(), 3).select("cell", F.transform("pc", lambda x: F.round(x, 4)).alias("pc"))


def _batch(spark, sf_dir, b: int):
    return vectors(spark, sf_dir).filter(F.col("id") % 3 == b)


@query()
def canonical_components(spark, sf_dir):
    """Components that two thirds of the embeddings share, with their singular values."""
    u, v, s, _ = K.canonical_vectors(K.standardised(_batch(spark, sf_dir, 0)), K.standardised(_batch(spark, sf_dir, 1)), 8)
    told = F.array(*(F.lit(float(x)) for x in s))
    return u.unionByName(v).select("id", F.posexplode("u").alias("component", "value")).withColumn("singular_value", F.element_at(told, F.col("component") + 1))


@query()
def canonical_anchors(spark, sf_dir):
    return D.rounded(K.canonical_anchors(_batch(spark, sf_dir, 0), _batch(spark, sf_dir, 1), dims=10, top=32), "score")


@query()
def canonical_integration(spark, sf_dir):
    """Three batches of embeddings brought together along anchors."""
    v = vectors(spark, sf_dir)
    out = K.integrated(v, v, v.select("id", (F.col("id") % 3).alias("batch")), dims=10, top=32)
    return out.select("id", F.transform("embedding", lambda x: F.round(x, 5)).alias("embedding"))
