"""Single-cell queries: customers are cells, parts genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import cells as C
from helixframe.plans import data as D
from helixframe.plans.registry import query

_Q = f"WITH {D.COUNTS}, {D.OBS}, {D.SETS}"
_N = f"WITH {D.NORM}, {D.OBS}, {D.SETS}"


def _norm(spark, sf_dir):
    return C.normalised(D.counts(spark, sf_dir))


@query(f"{_Q}, g AS (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 20), l AS (SELECT * FROM counts WHERE gene IN (SELECT gene FROM g)), c AS (SELECT cell FROM l GROUP BY 1 HAVING sum(raw) >= 300 AND count(*) >= 10) SELECT * FROM l WHERE cell IN (SELECT cell FROM c)")
def quality_filter(spark, sf_dir):
    return C.quality_filter(D.counts(spark, sf_dir), 20, 300, 10)


@query(f"{_Q} SELECT cell, count(*) AS nnz, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts GROUP BY 1")
def cell_metrics(spark, sf_dir):
    return C.cell_metrics(D.counts(spark, sf_dir))


@query(f"{_Q} SELECT gene, count(*) AS n_cells, CAST(sum(raw) AS BIGINT) AS total FROM counts GROUP BY 1")
def gene_metrics(spark, sf_dir):
    return C.gene_metrics(D.counts(spark, sf_dir))


@query(f"{_N} SELECT cell, gene, raw, round(norm, 6) AS norm FROM norm")
def normalised_counts(spark, sf_dir):
    return D.rounded(_norm(spark, sf_dir), "norm")


@query(f"{_Q}, m AS (SELECT cell, sum(ln(1 + raw)) / 2000 AS o FROM counts GROUP BY 1) SELECT cell, gene, raw, round(ln(1 + raw) - o, 6) AS clr FROM counts JOIN m USING (cell)")
def clr_counts(spark, sf_dir):
    return D.rounded(C.clr(D.counts(spark, sf_dir), 2000), "clr")


@query(f"{_Q}, lib AS (SELECT cell, sum(raw) AS s FROM counts GROUP BY 1) SELECT cell, round(sum(ln(1 + raw / s)) / 2000, 9) AS offset_value FROM counts JOIN lib USING (cell) GROUP BY 1")
def clr_offsets(spark, sf_dir):
    return D.rounded(C.clr_offsets(D.counts(spark, sf_dir), 2000).withColumnRenamed("offset", "offset_value"), "offset_value", digits=9)


@query(f"{_Q}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY raw DESC, gene) AS rk FROM counts) SELECT cell, round(sum(raw) FILTER (rk <= 5) / sum(raw), 6) AS top_5, round(sum(raw) FILTER (rk <= 20) / sum(raw), 6) AS top_20 FROM r GROUP BY 1")
def top_gene_fractions(spark, sf_dir):
    return D.rounded(C.top_gene_fractions(D.counts(spark, sf_dir), [5, 20]), "top_5", "top_20")


@query(f"{_Q}, lib AS (SELECT cell, sum(raw) AS s FROM counts GROUP BY 1) SELECT cell, set_id, round(sum(raw) / max(s), 6) AS fraction FROM counts JOIN sets ON gene = member JOIN lib USING (cell) GROUP BY 1, 2")
def gene_set_fractions(spark, sf_dir):
    return D.rounded(C.gene_set_fractions(D.counts(spark, sf_dir), D.sets(spark, sf_dir)), "fraction")


@query(f"""{_Q}, q AS (SELECT cell, segment, CAST(sum(raw) AS DOUBLE) AS lib_size FROM counts JOIN obs USING (cell) GROUP BY 1, 2),
m AS (SELECT segment, median(lib_size) AS med, 3 * 1.4826 * mad(lib_size) AS off FROM q GROUP BY 1)
SELECT cell, segment, lib_size, med AS median, round(med - off, 6) AS lower, round(med + off, 6) AS upper, lib_size < med - off OR lib_size > med + off AS outlier FROM q JOIN m USING (segment)""")
def mad_outliers(spark, sf_dir):
    q = C.cell_metrics(D.counts(spark, sf_dir)).join(D.obs(spark, sf_dir), "cell").select("cell", "segment", F.col("lib_size").cast("double").alias("lib_size"))
    return D.rounded(C.mad_outliers(q, "lib_size", "segment"), "lower", "upper")


@query(f"""{_Q}, q AS (SELECT cell, batch, CAST(sum(raw) AS DOUBLE) AS lib_size FROM counts JOIN obs USING (cell) GROUP BY 1, 2), g AS (SELECT batch, median(lib_size) AS group_median FROM q GROUP BY 1),
m AS (SELECT median(group_median) AS med, 3 * 1.4826 * mad(group_median) AS off FROM g)
SELECT batch, group_median, med AS median, round(med - off, 6) AS lower, round(med + off, 6) AS upper, group_median < med - off OR group_median > med + off AS outlier FROM g CROSS JOIN m""")
def group_outliers(spark, sf_dir):
    q = C.cell_metrics(D.counts(spark, sf_dir)).join(D.obs(spark, sf_dir), "cell").select("batch", F.col("lib_size").cast("double").alias("lib_size"))
    return D.rounded(C.group_outliers(q, "lib_size", "batch"), "lower", "upper")


@query(f"{_Q}, q AS (SELECT cell, count(*) AS nnz, CAST(sum(raw) AS BIGINT) AS lib_size FROM counts GROUP BY 1) SELECT *, lib_size < 600 OR lib_size > 1500 OR nnz < 25 AS flagged FROM q")
def hard_threshold_flags(spark, sf_dir):
    return C.cell_metrics(D.counts(spark, sf_dir)).withColumn("flagged", C.hard_flags(None, {"lib_size": (600, 1500), "nnz": (25, None)}))


@query(f"{_N}, z AS (SELECT segment, count(*) AS n FROM obs GROUP BY 1) SELECT segment, gene, round(sum(norm) / max(n), 6) AS mean_expr, round(count(*) / max(n), 6) AS pct_expr FROM norm JOIN obs USING (cell) JOIN z USING (segment) GROUP BY 1, 2")
def grouped_gene_stats(spark, sf_dir):
    return D.rounded(C.grouped_gene_stats(_norm(spark, sf_dir), D.obs(spark, sf_dir), "segment"), "mean_expr", "pct_expr")


@query(f"{_N}, z AS (SELECT segment, count(*) AS n FROM obs GROUP BY 1) SELECT segment, gene, CAST(sum(raw) AS BIGINT) AS raw, round(sum(norm) / max(n), 6) AS norm FROM norm JOIN obs USING (cell) JOIN z USING (segment) GROUP BY 1, 2")
def pseudobulk(spark, sf_dir):
    return D.rounded(C.pseudobulk(_norm(spark, sf_dir), D.obs(spark, sf_dir), "segment"), "norm")


@query(f"""{_Q}, n AS (SELECT count(*) AS n FROM obs), g AS (SELECT gene, sum(raw) / max(n) AS mean, sum(CAST(raw AS DOUBLE) * raw) / max(n) - (sum(raw) / max(n)) * (sum(raw) / max(n)) AS variance FROM counts CROSS JOIN n GROUP BY 1)
SELECT gene, round(mean, 6) AS mean, round(variance, 6) AS variance, round(variance / mean, 6) AS dispersion, row_number() OVER (ORDER BY round(variance / mean, 9) DESC, gene) <= 100 AS is_hvg FROM g""")
def variable_genes_dispersion(spark, sf_dir):
    n = D.obs(spark, sf_dir).count()
    return D.rounded(C.dispersion_hvg(D.counts(spark, sf_dir), n, 100), "mean", "variance", "dispersion")


@query()
def variable_genes_vst(spark, sf_dir):
    n = D.obs(spark, sf_dir).count()
    return D.rounded(C.vst_hvg(D.counts(spark, sf_dir), n, 100), "mean", "variance", "variance_std")


@query(f"""{_Q}, b AS (SELECT segment AS batch, gene, sum(CAST(raw AS DOUBLE) * raw) / sum(raw) AS score FROM counts JOIN obs USING (cell) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY round(score, 9) DESC, gene) AS rk FROM b), g AS (SELECT gene, count(*) FILTER (rk <= 100) AS n_batches, avg(score) AS mean_score FROM r GROUP BY 1)
SELECT gene, n_batches, round(mean_score, 6) AS mean_score, row_number() OVER (ORDER BY round(mean_score, 9) DESC, gene) <= 100 AS is_hvg FROM g""")
def variable_genes_by_batch(spark, sf_dir):
    x = F.col("raw").cast("double")
    per = D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell").groupBy(F.col("segment").alias("batch"), "gene").agg((F.sum(x * x) / F.sum("raw")).alias("score"))
    return D.rounded(C.combine_hvg(per, 100), "mean_score")


_MARKERS = f"""{_N}, x AS (SELECT c.cell, g.gene, c.segment, coalesce(norm, 0.0) AS v FROM obs c CROSS JOIN (SELECT DISTINCT gene FROM norm) g LEFT JOIN norm n ON n.cell = c.cell AND n.gene = g.gene),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, v) AS t FROM x),
a AS (SELECT gene, count(*) AS n, sum((t * t - 1.0)) AS ties, sum(exp(v) - 1) AS s, count(*) FILTER (v > 0) AS nnz FROM r GROUP BY 1),
g AS (SELECT segment, gene, count(*) AS n1, sum(rk) AS rs, sum(exp(v) - 1) AS s1, count(*) FILTER (v > 0) AS c1 FROM r GROUP BY 1, 2),
z AS (SELECT *, n - n1 AS n2 FROM g JOIN a USING (gene) WHERE c1 > 0)"""


@query(_MARKERS + """
SELECT segment, gene, round(log2((s1 / n1 + 1) / ((s - s1) / n2 + 1)), 5) AS lfc, round(c1 / n1, 6) AS prop1, round((nnz - c1) / n2, 6) AS prop2,
round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))), 5) AS z FROM z WHERE greatest(c1 / n1, (nnz - c1) / n2) >= 0.02""")
def markers_one_vs_rest(spark, sf_dir):
    n = C.normalised(D.counts(spark, sf_dir))
    return D.rounded(C.markers(n, D.obs(spark, sf_dir), "segment", min_prop=0.02).drop("p", "fdr"), "lfc", "z", digits=5).withColumns({c: F.round(c, 6) for c in ("prop1", "prop2")})


@query(f"""{_N}, a AS (SELECT gene, sum(norm) / (SELECT count(*) FROM customer) AS a FROM norm GROUP BY 1), bn AS (SELECT gene, ntile(24) OVER (ORDER BY a, gene) AS bin FROM a), m AS (SELECT set_id, member AS gene, bin FROM sets JOIN bn ON gene = member),
nd AS (SELECT set_id, bin, count(*) AS members FROM m GROUP BY 1, 2), sz AS (SELECT set_id, count(*) AS m FROM m GROUP BY 1), dr AS (SELECT set_id, bin, members, gene, row_number() OVER (PARTITION BY set_id, bin ORDER BY md5(concat_ws('|', gene, set_id, 42)), gene) AS i FROM nd JOIN bn USING (bin)),
wt AS (SELECT set_id, gene, sum(w) AS w FROM (SELECT set_id, gene, 1.0 AS w FROM m UNION ALL SELECT set_id, gene, -members / CAST(count(*) OVER (PARTITION BY set_id, bin) AS DOUBLE) FROM dr WHERE i <= 100) GROUP BY 1, 2)
SELECT cell, set_id, round(sum(norm * w / sz.m), 6) AS score FROM norm JOIN wt USING (gene) JOIN sz USING (set_id) GROUP BY 1, 2""")
def module_scores(spark, sf_dir):
    return D.rounded(C.module_scores(_norm(spark, sf_dir), D.sets(spark, sf_dir), D.obs(spark, sf_dir).count()), "score")


def _markers(spark, sf_dir):
    """Brands 1 to 9 are types: parts of size 10 and less are positive markers, the largest negative."""
    p = D.table(spark, sf_dir, "part").filter("p_size <= 10 or p_size > 45")
    return p.filter(F.length("p_brand") == 7).select(F.col("p_brand").alias("cell_type"), F.col("p_partkey").alias("gene"), F.when(F.col("p_size") <= 10, 1).otherwise(-1).alias("sign"))


_TYPES = f"""{_N}, n AS (SELECT count(*) AS n FROM obs), mk AS (SELECT p_brand AS cell_type, p_partkey AS gene, CASE WHEN p_size <= 10 THEN 1 ELSE -1 END AS sign FROM part WHERE (p_size <= 10 OR p_size > 45) AND length(p_brand) = 7),
g AS (SELECT gene, sum(norm) / max(n) AS mu, sqrt((sum(norm * norm) - max(n) * pow(sum(norm) / max(n), 2)) / (max(n) - 1)) AS sd FROM norm CROSS JOIN n GROUP BY 1),
sen AS (SELECT gene, 1 - (count(DISTINCT cell_type) - 1.0) / ((SELECT count(DISTINCT cell_type) FROM mk) - 1) AS w FROM mk WHERE sign > 0 GROUP BY 1),
j AS (SELECT cell_type, mk.gene, sign * coalesce(w, 1.0) AS w, sign, mu, sd FROM mk JOIN g ON mk.gene = g.gene LEFT JOIN sen ON sen.gene = mk.gene WHERE sd > 0),
k AS (SELECT *, w / sqrt(count(*) OVER (PARTITION BY cell_type, sign)) / sd AS ww FROM j),
d AS (SELECT cell, cell_type, sum(norm * ww) AS got FROM norm JOIN k USING (gene) GROUP BY 1, 2), b AS (SELECT cell_type, sum(-mu * ww) AS base FROM k GROUP BY 1)"""


@query(_TYPES + """
SELECT cell, cell_type, round(got + base, 5) AS score FROM d JOIN b USING (cell_type)""")
def cell_type_scores(spark, sf_dir):
    return D.rounded(C.type_scores(_norm(spark, sf_dir), _markers(spark, sf_dir), D.obs(spark, sf_dir).count()), "score", digits=5)


@query(_TYPES + """, s AS (SELECT cell, cell_type, got + base AS score FROM d JOIN b USING (cell_type)), t AS (SELECT batch AS cluster, cell_type, sum(score) AS total FROM s JOIN obs USING (cell) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(total, 6) DESC, cell_type) AS r FROM t) SELECT cluster, cell_type, round(total, 4) AS total FROM r WHERE r = 1""")
def cluster_types(spark, sf_dir):
    s = C.type_scores(_norm(spark, sf_dir), _markers(spark, sf_dir), D.obs(spark, sf_dir).count())
    return D.rounded(C.assign_types(s, D.obs(spark, sf_dir).select("cell", F.col("batch").alias("cluster"))), "total", digits=4)


@query("""WITH c AS (SELECT c_nationkey AS batch, c_mktsegment AS segment, count(*) AS c FROM customer GROUP BY 1, 2), s AS (SELECT *, sum(c) OVER (PARTITION BY batch) AS n, row_number() OVER (PARTITION BY batch ORDER BY c DESC, segment) AS r FROM c)
SELECT batch, CAST(max(n) AS BIGINT) AS n, max(segment) FILTER (r = 1) AS top_label, round(max(c / n), 6) AS purity, round(-sum(c / n * ln(c / n)), 6) AS entropy FROM s GROUP BY 1""")
def group_purity(spark, sf_dir):
    return D.rounded(C.purity(D.obs(spark, sf_dir), "batch", "segment"), "purity", "entropy")


@query("WITH c AS (SELECT c_nationkey AS batch, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT batch, segment, n, round(n / sum(n) OVER (PARTITION BY batch), 6) AS share FROM c")
def sample_compositions(spark, sf_dir):
    return D.rounded(C.compositions(D.obs(spark, sf_dir), "batch", "segment"), "share")


@query("SELECT batch, row_number() OVER (ORDER BY n DESC, batch) AS community FROM (SELECT c_nationkey AS batch, count(*) AS n FROM customer GROUP BY 1)")
def communities_by_size(spark, sf_dir):
    return C.size_order(D.obs(spark, sf_dir), "batch").withColumn("community", F.col("community").cast("long"))


@query(f"{_Q}, q AS (SELECT cell, segment AS sample, sum(raw) AS score FROM counts JOIN obs USING (cell) GROUP BY 1, 2) SELECT sample, count(*) AS n, count(*) FILTER (score > 1200) AS n_doublets, round(count(*) FILTER (score > 1200) / count(*), 6) AS rate FROM q GROUP BY 1")
def doublet_rates(spark, sf_dir):
    q = C.cell_metrics(D.counts(spark, sf_dir)).join(D.obs(spark, sf_dir), "cell").select(F.col("segment").alias("sample"), F.col("lib_size").alias("score"))
    return D.rounded(C.doublet_rate(q, 1200), "rate")


@query(f"""{_Q}, t AS (SELECT CASE WHEN batch < 12 THEN 'a' ELSE 'b' END AS exp_id, cell, gene, raw FROM counts JOIN obs USING (cell)), g AS (SELECT gene FROM t GROUP BY 1 HAVING count(DISTINCT exp_id) = 2)
SELECT exp_id, exp_id || '_' || cell AS cell, gene, raw FROM t WHERE gene IN (SELECT gene FROM g)""")
def merged_experiments(spark, sf_dir):
    j = D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell")
    return C.merge_experiments({"a": j.filter("batch < 12").select("cell", "gene", "raw"), "b": j.filter("batch >= 12").select("cell", "gene", "raw")})


_RANKS = f"""{_N}, x AS (SELECT c.cell, g.gene, c.segment, coalesce(norm, 0.0) AS v FROM obs c CROSS JOIN (SELECT DISTINCT gene FROM norm) g LEFT JOIN norm n ON n.cell = c.cell AND n.gene = g.gene WHERE segment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, v) AS t FROM x),
a AS (SELECT gene, count(*) AS n, sum(t * t - 1.0) AS ties, count(*) FILTER (v > 0) AS nnz, count(*) FILTER (segment = 'BUILDING') AS n1, sum(rk) FILTER (segment = 'BUILDING') AS rs, sum(exp(v) - 1) FILTER (segment = 'BUILDING') AS s1, sum(exp(v) - 1) FILTER (segment <> 'BUILDING') AS s2, count(*) FILTER (v > 0 AND segment = 'BUILDING') AS c1 FROM r GROUP BY 1)"""


@query(_RANKS + """ SELECT gene, round(log2((s1 / n1 + 1) / (s2 / (n - n1) + 1)), 5) AS lfc, round(c1 / n1, 6) AS prop1, round((nnz - c1) / (n - n1), 6) AS prop2,
round((rs - n1 * (n1 + 1) / 2.0 - n1 * (n - n1) / 2.0) / sqrt(n1 * (n - n1) / 12.0 * (n + 1 - ties / (n * (n - 1.0)))), 5) AS z FROM a WHERE c1 > 0 AND greatest(c1 / n1, (nnz - c1) / (n - n1)) >= 0.02""")
def markers_two_groups(spark, sf_dir):
    o = D.obs(spark, sf_dir)
    m = C.two_group_markers(_norm(spark, sf_dir), o.filter("segment = 'BUILDING'"), o.filter("segment = 'MACHINERY'"), 0.02)
    return D.rounded(m.drop("p", "fdr"), "lfc", "z", digits=5).withColumns({c: F.round(c, 6) for c in ("prop1", "prop2")})


@query()
def marker_significance(spark, sf_dir):
    m = C.markers(C.normalised(D.counts(spark, sf_dir)), D.obs(spark, sf_dir), "segment", 0.02, "twosided")
    return D.rounded(m.select("segment", "gene", "p", "fdr"), "p", "fdr")


@query(f"""{_N}, s AS (SELECT segment, count(*) AS n FROM obs GROUP BY 1), c AS (SELECT gene, norm, segment, count(*) AS c FROM norm JOIN obs USING (cell) GROUP BY 1, 2, 3), z AS (SELECT gene, segment, sum(c) AS nnz FROM c GROUP BY 1, 2),
p AS (SELECT a.gene, a.segment, b.segment AS rival, sum(a.c * b.c * CASE WHEN a.norm > b.norm THEN 1.0 WHEN a.norm = b.norm THEN 0.5 ELSE 0 END) AS u FROM c a JOIN c b ON a.gene = b.gene AND a.segment <> b.segment GROUP BY 1, 2, 3),
q AS (SELECT z.gene, z.segment, s2.segment AS rival, (coalesce(u, 0) + z.nnz * (s2.n - coalesce(z2.nnz, 0)) + (s1.n - z.nnz) * (s2.n - coalesce(z2.nnz, 0)) / 2.0) / (s1.n * s2.n) AS auc FROM z JOIN s s1 USING (segment) JOIN s s2 ON s2.segment <> z.segment LEFT JOIN z z2 ON z2.gene = z.gene AND z2.segment = s2.segment LEFT JOIN p ON p.gene = z.gene AND p.segment = z.segment AND p.rival = s2.segment)
SELECT segment, gene, round(min(auc), 6) AS auc_min, round(quantile_cont(auc, 0.5), 6) AS auc_median, round(avg(auc), 6) AS auc_mean, count(*) AS rivals FROM q GROUP BY 1, 2""")
def specific_markers(spark, sf_dir):
    return D.rounded(C.specific_markers(_norm(spark, sf_dir), D.obs(spark, sf_dir), "segment"), "auc_min", "auc_median", "auc_mean")


@query(f"{_Q}, m AS (SELECT cell, count(*) AS nnz, sum(raw) AS lib FROM counts GROUP BY 1) SELECT cell, nnz, CAST(lib AS BIGINT) AS lib_size, (nnz < 15 OR lib > 1500) AND (nnz < 12 OR nnz > 60 OR lib > 1600) AS outlier FROM m")
def rescued_cells(spark, sf_dir):
    m = C.cell_metrics(D.counts(spark, sf_dir))
    m = m.withColumn("outlier", C.hard_flags(m, {"nnz": (15, None), "lib_size": (None, 1500)}))
    return C.rescued(m, {"nnz": (12, 60), "lib_size": (None, 1600)})


@query("SELECT p_partkey AS gene, p_name, coalesce(contains(lower(p_name), 'blue'), false) AS is_isotype FROM part")
def isotype_controls(spark, sf_dir):
    return C.isotype_controls(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), "p_name"), "p_name", "Blue")


@query(f"{_Q}, l AS (SELECT p_brand AS cell_type, p_partkey AS gene, CASE WHEN p_size <= 10 THEN 1 ELSE -1 END AS sign FROM part WHERE p_size <= 10 OR p_size > 45) SELECT DISTINCT cell_type, gene, sign FROM l WHERE gene IN (SELECT gene FROM counts)")
def present_markers(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    lists = p.groupBy(F.col("p_brand").alias("cell_type")).agg(F.collect_list(F.when(F.col("p_size") <= 10, F.col("p_partkey"))).alias("positive"), F.collect_list(F.when(F.col("p_size") > 45, F.col("p_partkey"))).alias("negative"))
    return C.present_markers(lists, D.counts(spark, sf_dir))


@query(_TYPES + """, s AS (SELECT cell, cell_type, got + base AS score FROM d JOIN b USING (cell_type)), e AS (SELECT a.cell AS src, b.cell AS dst FROM obs a JOIN obs b ON b.cell = a.cell + 1), m AS (SELECT cell, cell_type, sum(o) AS o, sum(a) AS a FROM (SELECT cell, cell_type, score AS o, NULL AS a FROM s UNION ALL SELECT src, cell_type, NULL, score FROM e JOIN s ON s.cell = dst) GROUP BY 1, 2),
x AS (SELECT m.cell, cell_type, CASE WHEN e.src IS NULL THEN o ELSE 0.5 * coalesce(o, 0) + 0.5 * coalesce(a, 0) END AS score FROM m LEFT JOIN e ON e.src = m.cell), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, cell_type) AS r, lead(score) OVER (PARTITION BY cell ORDER BY round(score, 9) DESC, cell_type) AS nx FROM x)
SELECT cell, cell_type, round(score, 5) AS score, round(score - nx, 5) AS margin FROM r WHERE r = 1""")
def types_of_cells(spark, sf_dir):
    """Each customer mixed with the next one."""
    s = C.type_scores(_norm(spark, sf_dir), _markers(spark, sf_dir), D.obs(spark, sf_dir).count())
    o = D.obs(spark, sf_dir).select(F.col("cell").alias("src"))
    e = o.join(o.withColumnRenamed("src", "dst"), F.col("dst") == F.col("src") + 1).withColumn("weight", F.lit(1.0))
    return D.rounded(C.types_of_cells(s, e), "score", "margin", digits=5)


@query("WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, len(embedding) + 1) r(i)), d AS (SELECT label, i, var_pop(x) AS v, count(*) AS n FROM x GROUP BY 1, 2) SELECT label AS group_id, max(n) AS n, round(avg(v), 6) AS compactness FROM d GROUP BY 1")
def group_compactness(spark, sf_dir):
    e = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group_id"))
    return D.rounded(C.compactness(e.select("id", "embedding"), e.select("id", "group_id")), "compactness")


@query("WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, len(embedding) + 1) r(i) GROUP BY 1, 2), d AS (SELECT a.label, b.label AS other, sqrt(sum(pow(a.x - b.x, 2))) AS d FROM x a JOIN x b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2) SELECT CAST(label AS BIGINT) AS group_id, round(min(d), 6) AS separation FROM d GROUP BY 1")
def group_separation(spark, sf_dir):
    e = D.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group_id"))
    return D.rounded(C.separation(e.select("id", "embedding"), e.select("id", "group_id")), "separation")


def _steps():
    return [("filter", lambda c: C.quality_filter(c, 2, 10, 2), ("cell", "gene", "raw")), ("normalise", C.normalised, ("cell", "gene", "raw")), ("mean", lambda n: n.groupBy("gene").agg(F.avg("norm").alias("mean"), F.count("*").alias("n")), ("gene", "norm"))]


_STEPS = """, k AS ({k} FROM {c} GROUP BY {g} gene HAVING count(*) >= 2), l AS (SELECT c.* FROM {c} c JOIN k ON {on} k.gene = c.gene), q AS (SELECT {g} cell, sum(raw) AS lib FROM l GROUP BY {g} cell HAVING sum(raw) >= 10 AND count(*) >= 2)
SELECT {g} gene, round(avg(ln(1 + raw / lib * 10000.0)), 6) AS mean, count(*) AS n FROM l JOIN q USING ({g} cell) GROUP BY {g} gene"""


@query(_Q + _STEPS.format(k="SELECT gene", c="counts", g="", on=""))
def pipeline_of_steps(spark, sf_dir):
    from helixframe.operators.steps import applied

    return D.rounded(applied(D.counts(spark, sf_dir), _steps()), "mean")


@query(_Q + ", sc AS (SELECT counts.*, segment FROM counts JOIN obs USING (cell))" + _STEPS.format(k="SELECT segment, gene", c="sc", g="segment,", on="k.segment = c.segment AND"))
def pipeline_per_group(spark, sf_dir):
    from helixframe.operators.steps import applied_per_group

    return D.rounded(applied_per_group(D.counts(spark, sf_dir), D.obs(spark, sf_dir), "segment", _steps()), "mean")
