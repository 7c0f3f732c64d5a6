"""Set enrichment over parts: brands and types are the sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import enrichment as E
from helixframe.operators import multilevel as M
from helixframe.plans import data as D
from helixframe.plans.registry import query

_TARGETS = "targets AS (SELECT DISTINCT 'nation ' || c_nationkey AS target_id, l_partkey AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 49)"


#: Upper tail of the hypergeometric distribution, of hits, m, n and k.
_TAIL = "least(1.0, list_sum(list_transform(range(hits, least(m, k) + 1), lambda i: CASE WHEN n - m - k + i < 0 THEN 0.0 ELSE exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) END)))"


def targets(spark, sf_dir):
    """Parts of which a nation's customers bought 49 pieces or more at once."""
    li = D.table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select("l_orderkey", "l_partkey")
    o, c = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("target_id"), F.col("l_partkey").alias("member")).distinct()


@query(f"""WITH {D.SETS}, {_TARGETS}, n AS (SELECT count(*) AS n FROM part),
ss AS (SELECT set_id, count(*) AS m FROM sets GROUP BY 1), ts AS (SELECT target_id, count(*) AS k FROM targets GROUP BY 1),
h AS (SELECT target_id, set_id, count(*) AS hits FROM targets JOIN sets USING (member) GROUP BY 1, 2),
p AS (SELECT *, {_TAIL} AS pval FROM h JOIN ss USING (set_id) JOIN ts USING (target_id) CROSS JOIN n),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY pval, set_id) AS rn, (SELECT count(*) FROM ss) AS n_sets FROM p),
f AS (SELECT *, least(1.0, min(pval * n_sets / rn) OVER (PARTITION BY target_id ORDER BY rn DESC)) AS fdr FROM r)
SELECT target_id, set_id, hits, m AS set_size, k AS target_size, round(CAST(hits * (n - m - k + hits) AS DOUBLE) / nullif((k - hits) * (m - hits), 0), 6) AS odds_ratio, round(pval, 8) AS pval, round(fdr, 8) AS fdr FROM f WHERE hits >= 3""")
def hypergeometric_enrichment(spark, sf_dir):
    universe = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("member"))
    out = E.hypergeometric(targets(spark, sf_dir), D.sets(spark, sf_dir), universe, threshold=None)
    return D.rounded(D.rounded(out, "odds_ratio"), "pval", "fdr", digits=8)


def _level(level: int, gone: str | None) -> str:
    """Tables of one level: its p-values, significant terms, and all that is gone from there up."""
    left = f"LEFT JOIN {gone} gn ON gn.target_id = t.target_id AND gn.term = tm.term AND gn.member = tm.member" if gone else ""
    still = "WHERE gn.term IS NULL" if gone else ""
    lost = f"(SELECT gn.target_id, gn.term, count(*) AS lost FROM {gone} gn JOIN tm ON tm.term = gn.term AND tm.member = gn.member AND tm.level = {level} GROUP BY 1, 2)" if gone else "(SELECT '' AS target_id, '' AS term, 0 AS lost)"
    more = f"UNION SELECT * FROM {gone}" if gone else ""
    return f"""h{level} AS (SELECT t.target_id, tm.term, count(*) AS hits FROM targets t JOIN tm ON tm.member = t.member AND tm.level = {level} {left} {still} GROUP BY 1, 2),
c{level} AS (SELECT h.*, z.n AS all_n, z.n - coalesce(l.lost, 0) AS m, ts.k, u.n FROM h{level} h JOIN (SELECT term, count(*) AS n FROM tm WHERE level = {level} GROUP BY 1) z USING (term) JOIN ts USING (target_id) CROSS JOIN u LEFT JOIN {lost} l ON l.target_id = h.target_id AND l.term = h.term),
p{level} AS MATERIALIZED (SELECT target_id, term, {level} AS level, hits, m AS term_size, {_TAIL} AS pval FROM c{level}),
g{level} AS MATERIALIZED (SELECT DISTINCT p.target_id, up.ancestor AS term, tm.member FROM p{level} p JOIN tm ON tm.term = p.term AND tm.level = {level} JOIN up ON up.term = p.term WHERE pval <= 0.05 AND hits >= 1 {more})"""


@query(f"""WITH {_TARGETS}, u AS (SELECT count(*) AS n FROM part), ts AS (SELECT target_id, count(*) AS k FROM targets GROUP BY 1), tm AS (SELECT 'all' AS term, 0 AS level, p_partkey AS member FROM part UNION ALL SELECT p_type, 1, p_partkey FROM part UNION ALL SELECT p_type || '/' || p_brand, 2, p_partkey FROM part),
up AS (SELECT p_type || '/' || p_brand AS term, p_type AS ancestor FROM part UNION SELECT p_type || '/' || p_brand, 'all' FROM part UNION SELECT p_type, 'all' FROM part),
{_level(2, None)}, {_level(1, "g2")}, {_level(0, "g1")} SELECT target_id, term, level, hits, term_size, round(pval, 8) AS pval FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p0) WHERE hits >= 1""")
def elimination_enrichment(spark, sf_dir):
    """Three levels: all parts, types, and brands within a type."""
    p = D.table(spark, sf_dir, "part")
    pair = F.concat_ws("/", "p_type", "p_brand")
    terms = p.select(F.lit("all").alias("term"), F.lit(0).alias("level"), F.col("p_partkey").alias("member"))
    terms = terms.unionByName(p.select(F.col("p_type").alias("term"), F.lit(1).alias("level"), F.col("p_partkey").alias("member")))
    terms = terms.unionByName(p.select(pair.alias("term"), F.lit(2).alias("level"), F.col("p_partkey").alias("member")))
    up = p.select(pair.alias("term"), F.col("p_type").alias("ancestor")).unionByName(p.select(pair.alias("term"), F.lit("all").alias("ancestor"))).unionByName(p.select(F.col("p_type").alias("term"), F.lit("all").alias("ancestor"))).distinct()
    return D.rounded(E.elimination(targets(spark, sf_dir), terms, up, [0, 1, 2], p.count()), "pval", digits=8)


def _expr(spark, sf_dir):
    """sample = market segment, feature = part, value = pieces, no zeros: every segment buys most parts."""
    return D.counts(spark, sf_dir).join(D.obs(spark, sf_dir), "cell").groupBy(F.col("segment").alias("sample"), F.col("gene").alias("feature")).agg(F.sum("raw").cast("double").alias("value"))


_SEGMENT = f"WITH {D.COUNTS}, {D.OBS}, {D.SETS}, expr AS (SELECT segment AS sample, gene AS feature, CAST(sum(raw) AS DOUBLE) AS value FROM counts JOIN obs USING (cell) GROUP BY 1, 2)"


@query(_SEGMENT + """, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value, feature) AS rk, count(*) OVER (PARTITION BY sample) AS n FROM expr),
x AS (SELECT sample, s.set_id, feature, n, n - rk + 1 AS pos, CASE WHEN m.member IS NULL THEN 0.0 ELSE pow(CAST(rk AS DOUBLE), 0.25) END AS w, m.member IS NULL AS miss FROM r CROSS JOIN (SELECT DISTINCT set_id FROM sets) s LEFT JOIN sets m ON m.set_id = s.set_id AND m.member = r.feature),
run AS (SELECT sample, set_id, sum(w) OVER win / sum(w) OVER whole - CAST(sum(CAST(miss AS INT)) OVER win AS DOUBLE) / sum(CAST(miss AS INT)) OVER whole AS d FROM x WINDOW win AS (PARTITION BY sample, set_id ORDER BY pos), whole AS (PARTITION BY sample, set_id))
SELECT sample, set_id, round(sum(d), 4) AS score FROM run GROUP BY 1, 2""")
def ssgsea_scores(spark, sf_dir):
    return D.rounded(E.ssgsea(_expr(spark, sf_dir), D.sets(spark, sf_dir)), "score", digits=4)


@query(_SEGMENT + """, d AS (SELECT sample, feature, cume_dist() OVER (PARTITION BY feature ORDER BY value) AS d FROM expr), r AS (SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY d DESC, feature) AS pos, count(*) OVER (PARTITION BY sample) AS n FROM d),
x AS (SELECT sample, s.set_id, pos, CASE WHEN m.member IS NULL THEN 0.0 ELSE abs(n / 2.0 - pos + 1) END AS w, m.member IS NULL AS miss FROM r CROSS JOIN (SELECT DISTINCT set_id FROM sets) s LEFT JOIN sets m ON m.set_id = s.set_id AND m.member = r.feature),
run AS (SELECT sample, set_id, sum(w) OVER win / sum(w) OVER whole - CAST(sum(CAST(miss AS INT)) OVER win AS DOUBLE) / sum(CAST(miss AS INT)) OVER whole AS d FROM x WINDOW win AS (PARTITION BY sample, set_id ORDER BY pos), whole AS (PARTITION BY sample, set_id))
SELECT sample, set_id, round(greatest(0.0, max(d)) + least(0.0, min(d)), 5) AS score FROM run GROUP BY 1, 2""")
def gsva_scores(spark, sf_dir):
    return D.rounded(E.gsva(_expr(spark, sf_dir), D.sets(spark, sf_dir)), "score", digits=5)


@query(_SEGMENT + """, r AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) AS rk, count(*) OVER (PARTITION BY sample) AS n FROM expr),
h AS (SELECT sample, set_id, avg(rk) AS mean, count(*) AS m, max(n) AS n, 1.4826 * mad(CAST(rk AS DOUBLE)) AS dispersion FROM r JOIN sets ON feature = member GROUP BY 1, 2)
SELECT sample, set_id, round((mean - (m + 1) / 2.0) / ((2 * n - m + 1) / 2.0 - (m + 1) / 2.0) - 0.5, 6) AS score, round(dispersion, 6) AS dispersion FROM h WHERE n > m""")
def singscore_scores(spark, sf_dir):
    return D.rounded(E.singscore(_expr(spark, sf_dir), D.sets(spark, sf_dir)), "score", "dispersion")


def _stats(spark, sf_dir):
    """contrast = segment, stat = pieces less those that the mean over parts would give."""
    e = _expr(spark, sf_dir)
    mean = e.groupBy("sample").agg(F.avg("value").alias("mu"))
    return e.join(mean, "sample").select(F.col("sample").alias("contrast"), "feature", F.round(F.col("value") - F.col("mu"), 3).alias("stat"))


_STATS = _SEGMENT + ", stats AS (SELECT sample AS contrast, feature, round(value - avg(value) OVER (PARTITION BY sample), 3) AS stat FROM expr)"


@query(_STATS + """, r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY stat DESC, feature) AS pos FROM stats),
x AS (SELECT contrast, s.set_id, pos, CASE WHEN m.member IS NULL THEN 0.0 ELSE abs(stat) END AS w, m.member IS NULL AS miss FROM r CROSS JOIN (SELECT DISTINCT set_id FROM sets) s LEFT JOIN sets m ON m.set_id = s.set_id AND m.member = r.feature),
run AS (SELECT contrast, set_id, count(*) FILTER (NOT miss) OVER whole AS size, sum(w) OVER win / sum(w) OVER whole - CAST(sum(CAST(miss AS INT)) OVER win AS DOUBLE) / sum(CAST(miss AS INT)) OVER whole AS d FROM x WINDOW win AS (PARTITION BY contrast, set_id ORDER BY pos), whole AS (PARTITION BY contrast, set_id)),
g AS (SELECT contrast, set_id, max(size) AS size, greatest(0.0, max(d)) AS hi, least(0.0, min(d)) AS lo FROM run GROUP BY 1, 2)
SELECT contrast, set_id, size, round(CASE WHEN hi > -lo THEN hi WHEN hi < -lo THEN lo ELSE 0 END, 6) AS es FROM g WHERE size BETWEEN 5 AND 500""")
def gsea_running_sum(spark, sf_dir):
    return D.rounded(E.gsea_statistic(_stats(spark, sf_dir), D.sets(spark, sf_dir)), "es")


def _dealt(permutations: int) -> str:
    """Statistics dealt to features anew, as permutations from 1 on; 0 are the real ones."""
    return _STATS + f""", n0 AS (SELECT contrast, count(*) AS n FROM stats GROUP BY 1), sh AS (SELECT contrast, perm, feature, row_number() OVER (PARTITION BY contrast, perm ORDER BY md5(concat_ws('|', feature, perm, 42)), feature) AS a, row_number() OVER (PARTITION BY contrast, perm ORDER BY stat DESC, feature) AS b, stat FROM stats CROSS JOIN range(1, {permutations + 1}) t(perm)),
al AS (SELECT x.contrast, x.perm, x.feature, y.stat FROM sh x JOIN sh y ON x.contrast = y.contrast AND x.perm = y.perm AND x.a = y.b UNION ALL SELECT contrast, 0, feature, stat FROM stats),
r AS (SELECT *, row_number() OVER (PARTITION BY contrast, perm ORDER BY stat DESC, feature) AS pos FROM al)"""


_DEALT = _dealt(20)


def _tested(sets: str, own: bool = False, mark: str = "", sizes: str = "m BETWEEN 5 AND 500") -> str:
    """Tables h, q, g, es and c of scores and p-values for a table of sets (set_id, member), `own` if sets have a contrast."""
    joined = f"JOIN {sets} s ON feature = member" + (" AND s.contrast = r.contrast" if own else "")
    return f"""h{mark} AS (SELECT r.contrast, perm, set_id, pos, abs(stat) AS w, count(*) OVER o AS m, row_number() OVER (o ORDER BY pos) AS i FROM r {joined} WINDOW o AS (PARTITION BY r.contrast, perm, set_id)),
q{mark} AS (SELECT contrast, perm, set_id, m, w / sum(w) OVER o AS part, sum(w) OVER (o ORDER BY pos) / sum(w) OVER o AS run, (pos - i) / CAST(n - m AS DOUBLE) AS miss FROM h{mark} JOIN n0 USING (contrast) WHERE {sizes} AND m < n WINDOW o AS (PARTITION BY contrast, perm, set_id)),
g{mark} AS (SELECT contrast, perm, set_id, max(m) AS size, max(run - miss) AS hi, min(run - part - miss) AS lo FROM q{mark} GROUP BY 1, 2, 3), es{mark} AS (SELECT contrast, perm, set_id, size, CASE WHEN hi > -lo THEN hi WHEN hi < -lo THEN lo ELSE 0 END AS es FROM g{mark}),
c{mark} AS (SELECT a.contrast, a.set_id, a.size, a.es, count(*) FILTER (sign(b.es) = sign(a.es) AND abs(b.es) >= abs(a.es)) AS far, count(*) FILTER (sign(b.es) = sign(a.es)) AS same FROM es{mark} a LEFT JOIN es{mark} b ON a.contrast = b.contrast AND a.set_id = b.set_id AND b.perm > 0 WHERE a.perm = 0 GROUP BY 1, 2, 3, 4)"""


@query(f"{_DEALT}, {_tested('sets')} SELECT contrast, set_id, size, round(es, 6) AS es, round((far + 1) / (same + 1), 6) AS pval FROM c")
def gsea_permutation_test(spark, sf_dir):
    return D.rounded(E.gsea_permutations(_stats(spark, sf_dir), D.sets(spark, sf_dir), permutations=20), "es", "pval")


@query(_STATS + """, r AS (SELECT *, rank() OVER (PARTITION BY contrast ORDER BY stat) + (count(*) OVER (PARTITION BY contrast, stat) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY contrast) AS n FROM stats),
g AS (SELECT contrast, set_id, count(*) AS size, sum(rk) AS held, max(n) AS n FROM r JOIN sets ON feature = member GROUP BY 1, 2)
SELECT contrast, set_id, size, round(2 * (held / size - (n * (n + 1) / 2.0 - held) / (n - size)) / n, 6) AS s FROM g WHERE size >= 5 AND size < n""")
def mitch_scores(spark, sf_dir):
    return D.rounded(E.mitch(_stats(spark, sf_dir), D.sets(spark, sf_dir)), "s")


@query(f"""WITH {D.COUNTS}, {D.SETS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY raw DESC, gene) AS rk FROM counts), m AS (SELECT set_id, count(*) AS m FROM sets GROUP BY 1),
g AS (SELECT cell, set_id, sum(25 - rk) AS area FROM r JOIN sets ON gene = member WHERE rk < 25 GROUP BY 1, 2)
SELECT cell, set_id, round(area / (least(m, 24) * 25 - least(m, 24) * (least(m, 24) + 1) / 2.0), 6) AS auc FROM g JOIN m USING (set_id)""")
def aucell_scores(spark, sf_dir):
    return D.rounded(E.aucell(D.counts(spark, sf_dir), D.sets(spark, sf_dir), 25), "auc")


@query(_STATS + """, rk AS (SELECT contrast AS motif, feature, row_number() OVER (PARTITION BY contrast ORDER BY stat DESC, feature) AS rank FROM stats),
m AS (SELECT set_id, count(*) AS m FROM sets GROUP BY 1), hit AS (SELECT set_id, motif, sum(100 - rank) AS area FROM rk JOIN sets ON feature = member WHERE rank < 100 GROUP BY 1, 2),
a AS (SELECT m.set_id, t.motif, coalesce(area, 0) / (m * 100.0) AS auc FROM m CROSS JOIN (SELECT DISTINCT motif FROM rk) t LEFT JOIN hit ON hit.set_id = m.set_id AND hit.motif = t.motif)
SELECT set_id, motif, round(auc, 9) AS auc, round((auc - avg(auc) OVER w) / nullif(stddev_samp(auc) OVER w, 0), 5) AS nes FROM a WINDOW w AS (PARTITION BY set_id)""")
def motif_recovery(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("contrast").orderBy(F.desc("stat"), "feature"))
    rankings = _stats(spark, sf_dir).select(F.col("contrast").alias("motif"), "feature", rank.alias("rank"))
    return D.rounded(D.rounded(E.recovery_enrichment(D.sets(spark, sf_dir), rankings, 100), "auc", digits=9), "nes", digits=5)


@query(_SEGMENT + " SELECT sample, feature, rank() OVER (PARTITION BY sample ORDER BY value) AS rank FROM expr")
def rank_matrix(spark, sf_dir):
    return E.rank_matrix(_expr(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(_SEGMENT + ", m AS (SELECT *, CAST(feature % 20 = 0 AS INT) AS ref FROM expr) SELECT sample, feature, round(sum(ref) OVER (PARTITION BY sample ORDER BY value RANGE UNBOUNDED PRECEDING) / CAST(sum(ref) OVER (PARTITION BY sample) AS DOUBLE), 6) AS rank FROM m")
def stable_rank_matrix(spark, sf_dir):
    """Every twentieth part is a stable one."""
    stable = D.table(spark, sf_dir, "part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("feature"))
    return D.rounded(E.rank_matrix(_expr(spark, sf_dir), stable), "rank")


def _sides(spark, sf_dir):
    p = D.table(spark, sf_dir, "part")
    of = lambda c: p.filter(c).select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("member"))
    return of("p_size <= 25"), of("p_size > 25")


@query(_SEGMENT + """, r AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) AS lo, rank() OVER (PARTITION BY sample ORDER BY value DESC) AS hi, count(*) OVER (PARTITION BY sample) AS n FROM expr),
u AS (SELECT sample, p_brand AS set_id, avg(lo) AS mean, count(*) AS m, max(n) AS n FROM r JOIN part ON feature = p_partkey WHERE p_size <= 25 GROUP BY 1, 2), w AS (SELECT sample, p_brand AS set_id, avg(hi) AS mean, count(*) AS m, max(n) AS n FROM r JOIN part ON feature = p_partkey WHERE p_size > 25 GROUP BY 1, 2),
a AS (SELECT sample, set_id, (mean - (m + 1) / 2.0) / ((2 * n - m + 1) / 2.0 - (m + 1) / 2.0) - 0.5 AS s FROM u WHERE n > m), b AS (SELECT sample, set_id, (mean - (m + 1) / 2.0) / ((2 * n - m + 1) / 2.0 - (m + 1) / 2.0) - 0.5 AS s FROM w WHERE n > m)
SELECT sample, set_id, round(a.s, 6) AS up_score, round(b.s, 6) AS down_score, round(coalesce(a.s, 0) + coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (sample, set_id)""")
def singscore_two_sided(spark, sf_dir):
    return D.rounded(E.singscore_two_sided(_expr(spark, sf_dir), *_sides(spark, sf_dir)), "up_score", "down_score", "score")


@query(_SEGMENT + """, r AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY value) AS rk, count(*) OVER (PARTITION BY sample) AS n FROM expr), z AS (SELECT set_id, count(*) AS m FROM sets WHERE member IN (SELECT feature FROM expr) GROUP BY 1),
re AS (SELECT sample, set_id, avg(rk) AS mean, count(*) AS m, max(n) AS n FROM r JOIN sets ON feature = member GROUP BY 1, 2), rs AS (SELECT sample, set_id, (mean - (m + 1) / 2.0) / ((2 * n - m + 1) / 2.0 - (m + 1) / 2.0) - 0.5 AS score FROM re WHERE n > m),
o AS (SELECT feature, draw, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', feature, draw, 42))) AS pos FROM (SELECT DISTINCT feature FROM expr) CROSS JOIN range(1, 21) t(draw)),
rn AS (SELECT sample, draw, n, row_number() OVER (PARTITION BY sample, draw ORDER BY pos) AS m, avg(rk) OVER (PARTITION BY sample, draw ORDER BY pos) AS mean FROM r JOIN o USING (feature) WHERE pos <= (SELECT max(m) FROM z)),
nu AS (SELECT sample, m, (mean - (m + 1) / 2.0) / ((2 * n - m + 1) / 2.0 - (m + 1) / 2.0) - 0.5 AS s FROM rn WHERE m IN (SELECT m FROM z) AND n > m)
SELECT rs.sample, rs.set_id, round(score, 6) AS score, round((count(*) FILTER (s >= score) + 1) / (count(*) + 1.0), 6) AS pval FROM rs JOIN z USING (set_id) JOIN nu ON nu.sample = rs.sample AND nu.m = z.m GROUP BY rs.sample, rs.set_id, score""")
def singscore_permutation_test(spark, sf_dir):
    return D.rounded(E.singscore_permutations(_expr(spark, sf_dir), D.sets(spark, sf_dir), 20), "score", "pval")


@query(_STATS + ", r AS (SELECT contrast, feature, row_number() OVER (PARTITION BY contrast ORDER BY stat DESC, feature) AS pos FROM stats) SELECT contrast, set_id, count(*) AS size, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM r JOIN sets ON feature = member GROUP BY 1, 2 HAVING count(*) BETWEEN 5 AND 500")
def set_positions(spark, sf_dir):
    p = E.set_positions(_stats(spark, sf_dir), D.sets(spark, sf_dir))
    return p.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(_STATS + """, r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY stat DESC, feature) AS pos, count(*) OVER (PARTITION BY contrast) AS n FROM stats), h AS (SELECT contrast, set_id, feature, pos, n, abs(stat) AS w, count(*) OVER o AS m, row_number() OVER (o ORDER BY pos) AS i FROM r JOIN sets ON feature = member WINDOW o AS (PARTITION BY contrast, set_id)),
q AS (SELECT *, w / sum(w) OVER o AS part, (pos - i) / CAST(n - m AS DOUBLE) AS miss FROM h WHERE m BETWEEN 5 AND 500 AND m < n WINDOW o AS (PARTITION BY contrast, set_id)), g AS (SELECT *, round(sum(part) OVER (PARTITION BY contrast, set_id ORDER BY pos) - miss, 12) AS hi FROM q),
k AS (SELECT *, round(hi - part, 12) AS lo, max(hi) OVER o AS up, min(round(hi - part, 12)) OVER o AS down FROM g WINDOW o AS (PARTITION BY contrast, set_id)), e AS (SELECT *, min(pos) FILTER (hi = up) OVER o AS pu, max(pos) FILTER (lo = down) OVER o AS pd FROM k WINDOW o AS (PARTITION BY contrast, set_id))
SELECT contrast, set_id, feature, pos AS "at" FROM e WHERE (up > -down AND pos <= pu) OR (up < -down AND pos >= pd)""")
def gsea_leading_edge(spark, sf_dir):
    return E.gsea_leading_edge(_stats(spark, sf_dir), D.sets(spark, sf_dir)).withColumn("at", F.col("at").cast("long"))


@query(f"""{_DEALT}, {_tested('sets')}, m AS (SELECT a.contrast, a.set_id, avg(abs(b.es)) FILTER (sign(b.es) = sign(a.es)) AS mean FROM es a LEFT JOIN es b ON a.contrast = b.contrast AND a.set_id = b.set_id AND b.perm > 0 WHERE a.perm = 0 GROUP BY 1, 2),
p AS (SELECT contrast, set_id, es, es / nullif(mean, 0) AS nes, (far + 1) / (same + 1) AS pval FROM c JOIN m USING (contrast, set_id)),
f AS (SELECT *, pval * count(*) OVER (PARTITION BY contrast) / row_number() OVER (PARTITION BY contrast ORDER BY pval, set_id) AS raw FROM p)
SELECT contrast, set_id, round(es, 6) AS es, round(nes, 6) AS nes, round(pval, 6) AS pval, round(least(1.0, min(raw) OVER (PARTITION BY contrast ORDER BY pval DESC, set_id DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr FROM f""")
def gsea_normalised(spark, sf_dir):
    stats, sets = _stats(spark, sf_dir), D.sets(spark, sf_dir)
    out = E.normalised_enrichment(E.gsea_statistic(stats, sets).drop("size"), E.permuted_statistics(stats, sets, 20))
    return D.rounded(out, "es", "nes", "pval", "fdr")


def _terms(spark, sf_dir):
    """Brands within a type below types, and which are below which."""
    p = D.table(spark, sf_dir, "part")
    pair = F.concat_ws("/", "p_type", "p_brand")
    rows = lambda term, level: p.select(term.alias("term"), F.lit(level).alias("level"), F.col("p_partkey").alias("member"))
    terms = rows(F.col("p_type"), 0).unionByName(rows(pair, 1))
    return terms, p.select(pair.alias("term"), F.col("p_type").alias("ancestor")).distinct()


@query()
def gsea_multilevel(spark, sf_dir):
    out = M.multilevel_enrichment(_stats(spark, sf_dir), D.sets(spark, sf_dir))
    return D.rounded(out, "es", "nes", "pval", "log2err", "fdr", digits=9)


@query()
def gsea_multilevel_elimination(spark, sf_dir):
    out = M.multilevel_elimination(_stats(spark, sf_dir), *_terms(spark, sf_dir), [0, 1])
    return D.rounded(out, "es", "nes", "pval", "log2err", "fdr", digits=9)


@query(f"""{_dealt(100)}, t AS (SELECT contrast, p_type AS type, p_type || '/' || p_brand AS pair, p_partkey AS member FROM part CROSS JOIN (SELECT DISTINCT contrast FROM stats)), s1 AS (SELECT contrast, pair AS set_id, member FROM t), {_tested('s1', True, '1', 'm >= 5')},
s0 AS (SELECT contrast, type AS set_id, member FROM t EXCEPT SELECT t.contrast, type, member FROM t JOIN c1 ON c1.contrast = t.contrast AND c1.set_id = pair WHERE (far + 1) / (same + 1) <= 0.05), {_tested('s0', True, '0', 'm >= 5')}
SELECT contrast, set_id AS term, level, size, round(es, 6) AS es, round((far + 1) / (same + 1), 6) AS pval FROM (SELECT *, 1 AS level FROM c1 UNION ALL SELECT *, 0 FROM c0)""")
def gsea_elimination(spark, sf_dir):
    """Brands within a type below types, below all parts; a type has more parts the larger the tables, so sizes have no upper
    limit. Of 20 permutations hardly a p-value could be below the threshold, as only those of the same sign count."""
    terms, up = _terms(spark, sf_dir)
    return D.rounded(E.gsea_elimination(_stats(spark, sf_dir), terms, up, [0, 1], permutations=100, max_size=None), "es", "pval")


@query()
def gsva_gaussian_scores(spark, sf_dir):
    return D.rounded(E.gsva(_expr(spark, sf_dir), D.sets(spark, sf_dir), kernel="gaussian"), "score", digits=5)
