"""Interactions between market segments: brands are genes, pairs of brands ligands and receptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import interactions as I
from helixframe.plans import data as D
from helixframe.plans.graphs import _EDGES, _FLOW
from helixframe.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_X = f"""WITH {D.EXPR}, g AS (SELECT c_mktsegment AS cluster_id, feature AS gene, sum(value) AS s, count(*) AS n FROM expr JOIN customer ON sample = c_custkey GROUP BY 1, 2),
de AS (SELECT cluster_id, gene, s / n AS avg_expr, s / n - sum(s) OVER (PARTITION BY gene) / sum(n) OVER (PARTITION BY gene) AS lfc, 1.0 / (1 + n) AS pval FROM g),
la AS (SELECT gene AS ligand, round(sum(avg_expr), 6) / 1000 AS aupr_corrected FROM de GROUP BY 1),
brands AS (SELECT DISTINCT p_brand AS b FROM part), lr AS (SELECT x.b AS ligand, y.b AS receptor FROM brands x JOIN brands y ON x.b < y.b WHERE length(x.b) = 7 AND length(y.b) = 8)"""


def _frames(spark, sf_dir):
    e = D.expr(spark, sf_dir).join(D.obs(spark, sf_dir).select(F.col("cell").alias("sample"), F.col("segment").alias("cluster_id")), "sample")
    g = e.groupBy("cluster_id", F.col("feature").alias("gene")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    t = g.groupBy("gene").agg((F.sum("s") / F.sum("n")).alias("mean"))
    de = g.join(t, "gene").select("cluster_id", "gene", (F.col("s") / F.col("n")).alias("avg_expr"), (F.col("s") / F.col("n") - F.col("mean")).alias("lfc"), (1 / (1 + F.col("n"))).alias("pval"))
    la = de.groupBy(F.col("gene").alias("ligand")).agg((F.round(F.sum("avg_expr"), 6) / 1000).alias("aupr_corrected"))
    b = D.table(spark, sf_dir, "part").select("p_brand").distinct()
    x, y = b.filter(F.length("p_brand") == 7).select(F.col("p_brand").alias("ligand")), b.filter(F.length("p_brand") == 8).select(F.col("p_brand").alias("receptor"))
    return de, la, x.join(y, F.col("ligand") < F.col("receptor"))


def _q(p, by):
    return f"quantile_cont({by[0]}, {p}) OVER (PARTITION BY {by[1]})"


@query(_X + f""", lig AS (SELECT DISTINCT ligand AS gene FROM lr), rec AS (SELECT DISTINCT receptor AS gene FROM lr),
ad AS (SELECT cluster_id, gene, avg_expr, -log10(greatest(pval, 2.2250738585072014e-308)) * sign(lfc) AS a FROM de),
dl AS (SELECT cluster_id AS sender, gene AS ligand, avg_expr, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM ad WHERE gene IN (SELECT gene FROM lig)),
dr AS (SELECT cluster_id AS receiver, gene AS receptor, avg_expr, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r FROM ad WHERE gene IN (SELECT gene FROM rec)),
l AS (SELECT sender, ligand, r / max(r) OVER () AS d, avg_expr, {_q(0.05, ('avg_expr', 'ligand'))} AS lo, {_q(0.95, ('avg_expr', 'ligand'))} AS hi FROM dl),
c AS (SELECT receiver, receptor, r / max(r) OVER () AS d, avg_expr, {_q(0.05, ('avg_expr', 'receptor'))} AS lo, {_q(0.95, ('avg_expr', 'receptor'))} AS hi FROM dr),
t AS (SELECT ligand, aupr_corrected AS x, quantile_cont(aupr_corrected, 0.01) OVER () AS lo, quantile_cont(aupr_corrected, 0.99) OVER () AS hi FROM la),
s AS (SELECT l.sender, l.ligand, c.receiver, c.receptor, (0.5 * l.d + 0.5 * c.d + 0.5 * CASE WHEN l.lo = l.hi THEN 0.5 ELSE (least(greatest(l.avg_expr, l.lo), l.hi) - l.lo) / (l.hi - l.lo) END
+ 0.5 * CASE WHEN c.lo = c.hi THEN 0.5 ELSE (least(greatest(c.avg_expr, c.lo), c.hi) - c.lo) / (c.hi - c.lo) END + CASE WHEN t.lo = t.hi THEN 0.5 ELSE (least(greatest(t.x, t.lo), t.hi) - t.lo) / (t.hi - t.lo) END) / 3 AS score
FROM lr JOIN l ON l.ligand = lr.ligand JOIN c ON c.receptor = lr.receptor JOIN t ON t.ligand = lr.ligand)
SELECT sender, receiver, ligand, receptor, round(score, 6) AS prioritisation_score, CAST(rank() OVER (ORDER BY round(score, 9) DESC) AS INT) AS prioritisation_rank FROM s""")
def prioritised_interactions(spark, sf_dir):
    de, la, lr = _frames(spark, sf_dir)
    names = [r[0] for r in D.obs(spark, sf_dir).select("segment").distinct().collect()]  # five segments
    out = I.prioritise_interactions(de.select("cluster_id", "gene", "lfc", "pval"), de, la, lr, names, names)
    return D.rounded(out.select("sender", "receiver", "ligand", "receptor", "prioritisation_score", "prioritisation_rank"), "prioritisation_score")


@query(f"""WITH {D.COUNTS}, {D.OBS}, inf AS (SELECT segment AS ligand, gene, CAST(sum(raw) AS BIGINT) AS score FROM counts JOIN obs USING (cell) GROUP BY 1, 2), tg AS (SELECT p_partkey AS gene FROM part WHERE p_size <= 5),
r AS (SELECT ligand, i.gene, t.gene IS NOT NULL AS hit, row_number() OVER w AS rank, count(t.gene) OVER (PARTITION BY ligand ORDER BY score DESC, i.gene ROWS UNBOUNDED PRECEDING) AS hits FROM inf i LEFT JOIN tg t ON t.gene = i.gene WINDOW w AS (PARTITION BY ligand ORDER BY score DESC, i.gene)),
g AS (SELECT ligand, count(*) FILTER (hit) AS p, count(*) AS n, sum(rank) FILTER (hit) AS s, sum(hits / rank) FILTER (hit) AS ap FROM r GROUP BY 1)
SELECT ligand, round((p * n - s - p * (p - 1) / 2.0) / (p * (n - p)), 6) AS auroc, round(ap / p - p / n, 6) AS aupr_corrected FROM g""")
def ligand_activity(spark, sf_dir):
    inf = D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell").groupBy(F.col("segment").alias("ligand"), "gene").agg(F.sum("raw").alias("score"))
    targets = D.table(spark, sf_dir, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("gene"))
    return D.rounded(I.ligand_activity(inf, targets), "auroc", "aupr_corrected")


@query(f"""WITH RECURSIVE {_EDGES.replace("0.85", "0.5")}, p AS (SELECT s_suppkey AS side, s_suppkey AS node, 1.0 AS score FROM supplier WHERE s_suppkey < 5), {_FLOW.replace("k < 180", "k < 60")}, q AS (SELECT side, quantile_cont(score, 0.5) AS cut FROM r GROUP BY 1)
SELECT side AS ligand, n_regionkey AS target, round(sum(score), 6) AS influence FROM r JOIN q USING (side) JOIN nation ON node = -1 - n_nationkey WHERE score >= cut GROUP BY 1, 2""")
def ligand_influence(spark, sf_dir):
    """Five suppliers as ligands, suppliers and nations as signalling, nations to regions as regulation."""
    from helixframe.operators.graphs import both_ways
    from helixframe.plans.graphs import edges

    net = both_ways(edges(spark, sf_dir))
    seeds = D.table(spark, sf_dir, "supplier").filter("s_suppkey < 5").select(F.col("s_suppkey").alias("ligand"), F.col("s_suppkey").alias("node"))
    reg = D.table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("src"), F.col("n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    return D.rounded(I.ligand_influence(seeds, net, reg, 0.5, 0.5), "influence")
