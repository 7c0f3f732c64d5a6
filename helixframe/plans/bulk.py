"""Bulk expression: nations as samples, regions as groups, parts as genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import bulk as B
from helixframe.plans import data as D
from helixframe.plans.registry import query
from helixframe.session import written

_B = f"WITH {D.COUNTS}, bulk AS (SELECT c_nationkey AS sample, gene, CAST(sum(raw) AS DOUBLE) AS count FROM counts JOIN customer ON cell = c_custkey GROUP BY 1, 2), grp AS (SELECT n_nationkey AS sample, n_regionkey AS grp FROM nation)"
_DENSE = _B + ", dense AS (SELECT s.sample, g.gene, coalesce(b.count, 0.0) AS count FROM (SELECT DISTINCT sample FROM bulk) s CROSS JOIN (SELECT DISTINCT gene FROM bulk) g LEFT JOIN bulk b ON b.sample = s.sample AND b.gene = g.gene)"


def bulk(spark, sf_dir):
    c = D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell")
    return c.groupBy(F.col("batch").alias("sample"), "gene").agg(F.sum("raw").cast("double").alias("count"))


def regions(spark, sf_dir):
    return D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("grp"))


def dense(spark, sf_dir):
    b = written(bulk(spark, sf_dir))  # read three times
    every = b.select("sample").distinct().join(b.select("gene").distinct())
    return every.join(b, ["sample", "gene"], "left").withColumn("count", F.coalesce("count", F.lit(0.0)))


@query(_B + ", d AS (SELECT sample, count(*) AS detected, count(*) / CAST((SELECT count(*) FROM part) AS DOUBLE) AS share FROM bulk WHERE count > 0 GROUP BY 1) SELECT sample, detected, round(share, 6) AS share, abs(share - avg(share) OVER ()) > 2 * coalesce(stddev_samp(share) OVER (), 0) AS outlier FROM d")
def sample_quality(spark, sf_dir):
    return D.rounded(B.sample_quality(bulk(spark, sf_dir), D.table(spark, sf_dir, "part").count()), "share")


@query(_B + """, lib AS (SELECT sample, sum(count) AS lib FROM bulk GROUP BY 1), c AS (SELECT 10 / quantile_cont(lib, 0.5) * 1e6 AS cut FROM lib), s AS (SELECT grp, count(*) AS n FROM grp GROUP BY 1),
k AS (SELECT gene, grp, count(*) AS k FROM bulk JOIN lib USING (sample) CROSS JOIN c JOIN grp USING (sample) WHERE count / lib * 1e6 >= cut GROUP BY 1, 2) SELECT gene, count(*) AS groups FROM k JOIN s USING (grp) WHERE k >= 0.2 * n GROUP BY 1""")
def expressed_genes(spark, sf_dir):
    return B.expressed_genes(bulk(spark, sf_dir), regions(spark, sf_dir))


@query(_B + " SELECT sample, gene, count FROM bulk WHERE sample NOT IN (SELECT sample FROM (SELECT sample, sum(count) AS s FROM bulk GROUP BY 1) ORDER BY s, sample LIMIT 3)")
def samples_removed(spark, sf_dir):
    b = bulk(spark, sf_dir)
    worst = b.groupBy("sample").agg(F.sum("count").alias("s")).orderBy("s", "sample").limit(3)
    return B.without_samples(b, worst)


@query(r"SELECT n_nationkey, regexp_replace(regexp_replace(n_name || ' ' || n_nationkey, '[^A-Za-z0-9._]', '.', 'g'), '^([^A-Za-z.])', 'X\1') AS name, CASE n_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def tidy_metadata(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("name"), F.col("n_regionkey").cast("string").alias("region"))
    return B.replaced_values(B.plain_names(n, ["name"]), "region", {"0": "first", "1": "second"})


@query(_B + ", nm AS (SELECT p_partkey AS gene, CASE WHEN p_partkey % 7 <> 0 THEN p_brand || p_size END AS other FROM part), o AS (SELECT other, min(gene) AS gene FROM nm WHERE other IS NOT NULL GROUP BY 1) SELECT sample, other AS gene, count FROM bulk JOIN o USING (gene)")
def other_identifiers(spark, sf_dir):
    names = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", F.col("p_size").cast("string"))).alias("other"))
    return B.other_identifiers(bulk(spark, sf_dir), names)


@query(_B + ", l AS (SELECT p_partkey AS gene, p_size * 100.0 AS length FROM part WHERE p_partkey % 5 <> 0), g AS (SELECT DISTINCT gene FROM bulk) SELECT g.gene, round(coalesce(length, (SELECT quantile_cont(length, 0.5) FROM g JOIN l USING (gene))), 4) AS length, length IS NOT NULL AS known FROM g LEFT JOIN l USING (gene)")
def gene_lengths(spark, sf_dir):
    lengths = D.table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100.0).alias("length"))
    return D.rounded(B.gene_lengths(bulk(spark, sf_dir), lengths), "length", digits=4)


@query(_B + ", lib AS (SELECT sample, sum(count) AS lib FROM bulk GROUP BY 1), f AS (SELECT sample, quantile_cont(count, 0.75) / max(lib) AS f FROM bulk JOIN lib USING (sample) WHERE count > 0 GROUP BY 1) SELECT sample, round(f / exp(avg(ln(f)) OVER ()), 6) AS factor FROM f")
def size_factors_upper_quartile(spark, sf_dir):
    return D.rounded(B.size_factors(bulk(spark, sf_dir)), "factor")


@query(_B + ", br AS (SELECT sample, p_brand AS gene, sum(count) AS count FROM bulk JOIN part ON gene = p_partkey GROUP BY 1, 2), lib AS (SELECT sample, sum(count) AS lib FROM br GROUP BY 1), m AS (SELECT gene, avg(ln(count)) AS mid FROM br GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM lib)), f AS (SELECT sample, exp(quantile_cont(ln(count) - mid, 0.5)) / max(lib) AS f FROM br JOIN m USING (gene) JOIN lib USING (sample) GROUP BY 1) SELECT sample, round(f / exp(avg(ln(f)) OVER ()), 6) AS factor FROM f")
def size_factors_median_ratio(spark, sf_dir):
    """Of brands, which every nation buys."""
    p = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), "p_brand")
    brands = bulk(spark, sf_dir).join(p, "gene").groupBy("sample", F.col("p_brand").alias("gene")).agg(F.sum("count").alias("count"))
    return D.rounded(B.size_factors(brands, "rle"), "factor")


def _contrast(spark, sf_dir):
    b = dense(spark, sf_dir)
    lib = b.groupBy("sample").agg(F.sum("count").alias("lib"))
    v = b.join(lib, "sample").select("sample", "gene", F.log2((F.col("count") + 0.5) / (F.col("lib") + 1) * 1e6).alias("value"), F.lit(1.0).alias("weight"))
    return B.contrast_fits(B.group_fits(v, regions(spark, sf_dir)), 0, 1)


@query(_DENSE + """, v AS (SELECT sample, gene, grp, log2((count + 0.5) / (sum(count) OVER (PARTITION BY sample) + 1) * 1e6) AS y FROM dense JOIN grp USING (sample)), m AS (SELECT gene, grp, avg(y) AS m, count(*) AS n, var_samp(y) * (count(*) - 1) AS ss FROM v GROUP BY 1, 2),
r AS (SELECT gene, sum(ss) / (sum(n) - count(*)) AS s2, CAST(sum(n) - count(*) AS BIGINT) AS df FROM m GROUP BY 1)
SELECT r.gene, round(a.m - b.m, 6) AS lfc, round((a.m - b.m) / sqrt(s2 * (1 / a.n + 1 / b.n)), 5) AS t, df FROM r JOIN m a ON a.gene = r.gene AND a.grp = 0 JOIN m b ON b.gene = r.gene AND b.grp = 1""")
def linear_contrast(spark, sf_dir):
    return D.rounded(D.rounded(_contrast(spark, sf_dir), "lfc"), "t", digits=5).select("gene", "lfc", "t", "df")


@query()
def moderated_contrast(spark, sf_dir):
    return D.rounded(B.moderated(_contrast(spark, sf_dir)), "lfc", "t", "p")


@query()
def precision_weighted_contrast(spark, sf_dir):
    v = B.voom_weights(dense(spark, sf_dir), regions(spark, sf_dir))
    return D.rounded(B.moderated(B.contrast_fits(B.group_fits(v, regions(spark, sf_dir)), 0, 1)), "lfc", "t", "p")


@query()
def tested_neighbourhoods(spark, sf_dir):
    """Neighbourhoods of embeddings; samples are the last digits of the ids, groups their parity."""
    from helixframe.operators import graphs as G
    from helixframe.plans.graphs import knn, vectors

    v = vectors(spark, sf_dir)
    counts = G.neighbourhood_counts(knn(spark, sf_dir), v, v.select("id", (F.col("id") % 10).alias("label")))
    groups = spark.range(10).select(F.col("id").alias("sample"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("grp"))
    return D.rounded(B.tested_neighbourhoods(counts, groups, "even", "odd"), "lfc", "t", "p", "spatial_fdr", digits=5)
