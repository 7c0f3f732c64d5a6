"""Regulation: parts of the smallest size as factors, all parts as genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import cells as C
from helixframe.operators import networks as N
from helixframe.operators import regulation as R
from helixframe.plans import data as D
from helixframe.plans.graphs import _V, knn
from helixframe.plans.registry import query

#: Shared buyers of factor and gene over the root of the product of their buyers.
_IMP = f"WITH {D.NORM}, tf AS (SELECT p_partkey AS gene FROM part WHERE p_size = 1), b AS (SELECT gene, count(*) AS n FROM counts GROUP BY 1), imp AS (SELECT a.gene AS tf, c.gene, count(*) / sqrt(max(x.n) * max(y.n)) AS importance FROM counts a JOIN tf ON tf.gene = a.gene JOIN counts c ON c.cell = a.cell AND c.gene <> a.gene JOIN b x ON x.gene = a.gene JOIN b y ON y.gene = c.gene GROUP BY 1, 2)"


def importances(spark, sf_dir):
    c = D.counts(spark, sf_dir).select("cell", "gene")
    tf = D.table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("tf"))
    n = c.groupBy("gene").agg(F.count("*").alias("n"))
    a = c.withColumnRenamed("gene", "tf").join(tf, "tf")
    j = a.join(c, "cell").filter("tf <> gene").groupBy("tf", "gene").agg(F.count("*").alias("both"))
    j = j.join(n, "gene").join(n.select(F.col("gene").alias("tf"), F.col("n").alias("m")), "tf")
    return j.select("tf", "gene", (F.col("both") / F.sqrt(F.col("n") * F.col("m"))).alias("importance"))


@query(f"WITH {D.COUNTS}, n AS (SELECT count(*) AS n FROM customer), g AS (SELECT gene, CAST(sum(raw) AS BIGINT) AS total, count(*) / CAST(max(n) AS DOUBLE) AS share, max(n) AS n FROM counts CROSS JOIN n GROUP BY 1) SELECT gene, total, round(share, 6) AS share FROM g WHERE total >= 30 * n / 100.0 AND share >= 0.01")
def usable_genes(spark, sf_dir):
    return D.rounded(R.usable_genes(D.counts(spark, sf_dir), D.obs(spark, sf_dir).count(), 30), "share")


_TOP = "r AS (SELECT tf, gene, round(importance, 9) AS importance FROM imp), t AS (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY importance DESC, gene) AS g, row_number() OVER (PARTITION BY gene ORDER BY importance DESC, tf) AS f FROM r)"


def _rounded(spark, sf_dir):
    return D.rounded(importances(spark, sf_dir), "importance", digits=9)


@query(f"{_IMP}, {_TOP} SELECT tf, gene, importance FROM t WHERE g <= 20 AND f <= 5")
def top_targets(spark, sf_dir):
    return R.top_targets(_rounded(spark, sf_dir), 20, 5)


@query(f"{_IMP}, r AS (SELECT tf, gene, round(importance, 9) AS importance FROM imp), m AS (SELECT gene, avg(importance) + 2 * coalesce(stddev_samp(importance), 0) AS cut FROM r GROUP BY 1) SELECT tf, r.gene, importance FROM r JOIN m USING (gene) WHERE importance > cut")
def outstanding_targets(spark, sf_dir):
    return R.outstanding_targets(_rounded(spark, sf_dir))


_SIGNED = _IMP + ", " + _TOP + """, p AS (SELECT tf, gene, importance FROM t WHERE g <= 20), n AS (SELECT count(*) AS n FROM customer), m AS (SELECT gene, sum(norm) AS s, sum(norm * norm) AS q FROM norm GROUP BY 1),
xy AS (SELECT p.tf, p.gene, sum(a.norm * b.norm) AS xy FROM p JOIN norm a ON a.gene = p.tf JOIN norm b ON b.cell = a.cell AND b.gene = p.gene GROUP BY 1, 2),
c AS (SELECT p.tf, p.gene, importance, (coalesce(xy, 0) - a.s * b.s / n) / sqrt((a.q - a.s * a.s / n) * (b.q - b.s * b.s / n)) AS cor FROM p JOIN m a ON a.gene = p.tf JOIN m b ON b.gene = p.gene CROSS JOIN n LEFT JOIN xy ON xy.tf = p.tf AND xy.gene = p.gene),
sg AS (SELECT *, CAST(sign(cor) AS INT) AS sign FROM c WHERE abs(cor) >= 0.03)"""


def _signed(spark, sf_dir):
    from helixframe.operators.pairwise import pearson_of_pairs

    pairs = R.top_targets(_rounded(spark, sf_dir), 20, None)
    norm = C.normalised(D.counts(spark, sf_dir)).select(F.col("cell").alias("sample"), F.col("gene").alias("feature"), F.col("norm").alias("value"))
    cor = pearson_of_pairs(norm, pairs.select(F.col("tf").alias("f1"), F.col("gene").alias("f2")), D.obs(spark, sf_dir).count())
    return R.signed_targets(pairs, cor)


@query(f"{_SIGNED} SELECT tf, gene, importance, round(cor, 6) AS cor, sign FROM sg")
def signed_targets(spark, sf_dir):
    return D.rounded(_signed(spark, sf_dir), "cor")


@query(f"{_SIGNED}, u AS (SELECT tf, gene, sign FROM sg UNION SELECT tf, tf, sign FROM sg), z AS (SELECT tf, sign FROM u GROUP BY 1, 2 HAVING count(*) >= 10) SELECT u.tf || CASE WHEN u.sign > 0 THEN '(+)' ELSE '(-)' END AS set_id, gene AS member FROM u JOIN z ON z.tf = u.tf AND z.sign = u.sign")
def regulons(spark, sf_dir):
    return R.regulons(_signed(spark, sf_dir))


@query(f"""WITH {D.COUNTS}, {D.OBS}, {D.SETS}, x AS (SELECT segment AS motif, gene AS feature, sum(raw) AS v FROM counts JOIN obs USING (cell) GROUP BY 1, 2), rk AS (SELECT motif, feature, row_number() OVER (PARTITION BY motif ORDER BY v DESC, feature) AS rank FROM x),
h AS (SELECT set_id, motif, feature, rank FROM rk JOIN sets ON feature = member WHERE rank < 300), mc AS (SELECT set_id, rank, count(*) AS c FROM h GROUP BY 1, 2), mn AS (SELECT set_id, rank, sum(c) OVER (PARTITION BY set_id ORDER BY rank) / 5.0 AS mean FROM mc),
g AS (SELECT h.*, count(*) OVER (PARTITION BY h.set_id, motif ORDER BY h.rank) AS got, mean FROM h JOIN mn ON mn.set_id = h.set_id AND mn.rank = h.rank), pk AS (SELECT set_id, motif, rank AS peak, row_number() OVER (PARTITION BY set_id, motif ORDER BY round(got - mean, 9) DESC, rank) AS r FROM g)
SELECT g.set_id, g.motif, feature, CAST(rank AS INT) AS rank FROM g JOIN pk ON pk.set_id = g.set_id AND pk.motif = g.motif AND r = 1 WHERE rank <= peak""")
def leading_members(spark, sf_dir):
    """Segments as motifs, parts ranked by pieces; every pair counts as enriched."""
    from pyspark.sql import Window

    x = D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell").groupBy(F.col("segment").alias("motif"), F.col("gene").alias("feature")).agg(F.sum("raw").alias("v"))
    rank = x.select("motif", "feature", F.row_number().over(Window.partitionBy("motif").orderBy(F.desc("v"), "feature")).alias("rank"))
    sets = D.sets(spark, sf_dir)
    every = sets.select("set_id").distinct().crossJoin(rank.select("motif").distinct())
    return R.leading_members(sets, rank, every, 300)


#: Brands as signed sets: large parts count negative.
_VISION = f"""WITH {D.NORM}, ss AS (SELECT p_brand AS set_id, p_partkey AS gene, CASE WHEN p_size <= 25 THEN 1 ELSE -1 END AS sign FROM part), c AS (SELECT cell, sum(norm) / (SELECT count(*) FROM part) AS mu, sum(norm * norm) / (SELECT count(*) FROM part) AS sq FROM norm GROUP BY 1),
z AS (SELECT set_id, count(*) AS n, sum(sign) AS s FROM ss GROUP BY 1), g AS (SELECT cell, set_id, sum(norm * sign) AS got FROM norm JOIN ss USING (gene) GROUP BY 1, 2),
sc AS (SELECT c.cell, z.set_id, (coalesce(got, 0) / n - mu * s / n) / (sqrt(sq - mu * mu) / sqrt(n)) AS score FROM c CROSS JOIN z LEFT JOIN g ON g.cell = c.cell AND g.set_id = z.set_id)"""


def _vision(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    sets = p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("member"), F.when(F.col("p_size") <= 25, 1).otherwise(-1).alias("sign"))
    return R.vision(C.normalised(D.counts(spark, sf_dir)), sets, p.count())


@query(f"{_VISION} SELECT cell, set_id, round(score, 5) AS score FROM sc")
def signed_set_scores(spark, sf_dir):
    return D.rounded(_vision(spark, sf_dir), "score", digits=5)


@query(_V.replace("WITH", _VISION + ",", 1) + """, m AS (SELECT set_id, count(*) AS n, var_pop(score) AS v FROM sc GROUP BY 1), e AS (SELECT a.set_id, sum(pow(a.score - b.score, 2)) AS d, count(*) AS w FROM knn JOIN sc a ON a.cell = knn.id JOIN sc b ON b.cell = knn.neighbour AND b.set_id = a.set_id GROUP BY 1)
SELECT set_id, round((n - 1) * d / (2 * w * n * v), 6) AS c, round(1 - (n - 1) * d / (2 * w * n * v), 6) AS consistency FROM e JOIN m USING (set_id)""")
def score_autocorrelation(spark, sf_dir):
    e = knn(spark, sf_dir).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.lit(1.0).alias("weight"))
    return D.rounded(R.geary(_vision(spark, sf_dir), e), "c", "consistency")


@query()
def factor_importances(spark, sf_dir):
    """Parts of the first size explain the pieces bought of all parts."""
    tf = D.table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("tf"))
    expr = D.counts(spark, sf_dir).withColumnRenamed("raw", "value")
    found = N.factor_importances(expr, tf, cells=D.obs(spark, sf_dir).count())
    return D.rounded(found, "importance", digits=9)
