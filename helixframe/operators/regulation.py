"""Regulation and activity: targets of transcription factors, regulons, signed set scores and their spread over a graph.

Importances are rows (tf, gene, importance), expression rows (cell, gene, norm) with zeros left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_genes(counts: DataFrame, n_cells: int, min_count: float = 3.0, min_share: float = 0.01) -> DataFrame:
    """(gene, total, share): genes with `min_count` counts for every hundredth cell and a count in `min_share` of all."""
    g = counts.groupBy("gene").agg(F.sum("raw").alias("total"), (F.count("*") / n_cells).alias("share"))
    return g.filter((F.col("total") >= min_count * n_cells / 100) & (F.col("share") >= min_share))


def top_targets(importances: DataFrame, k_genes: int | None, k_tfs: int | None, least: float | None = None) -> DataFrame:
    """Pairs among the `k_genes` largest of their factor, and among the `k_tfs` largest of their gene; None asks for
    nothing. Ties go to the smaller name."""
    some = importances if least is None else importances.filter(F.col("importance") >= least)
    by = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc("importance"), other))
    some = some.withColumn("g__", by("tf", "gene")).withColumn("t__", by("gene", "tf"))
    keep = F.lit(True)
    keep = keep & (F.col("g__") <= k_genes) if k_genes else keep
    keep = keep & (F.col("t__") <= k_tfs) if k_tfs else keep
    return some.filter(keep).drop("g__", "t__")


def outstanding_targets(importances: DataFrame, n_sd: float = 2.0, least: float | None = None) -> DataFrame:
    """Pairs above the mean of their gene by `n_sd` standard deviations."""
    m = importances.groupBy("gene").agg((F.avg("importance") + n_sd * F.coalesce(F.stddev_samp("importance"), F.lit(0.0))).alias("cut__"))
    out = importances.join(m, "gene").filter(F.col("importance") > F.col("cut__")).drop("cut__")
    return out if least is None else out.filter(F.col("importance") >= least)


def signed_targets(pairs: DataFrame, correlations: DataFrame, least: float = 0.03, mode: str = "both", remove_self: bool = True) -> DataFrame:
    """(tf, gene, importance, cor, sign) of pairs whose correlation (f1, f2, cor) of factor and gene reaches `least` in
    absolute terms; `activating` keeps positive ones, `repressing` negative ones."""
    c = correlations.select(F.col("f1").alias("tf"), F.col("f2").alias("gene"), "cor")
    j = pairs.join(c, ["tf", "gene"]).filter(F.abs("cor") >= least).withColumn("sign", F.signum("cor").cast("int"))
    j = j.filter("tf <> gene") if remove_self else j
    return {"both": j, "activating": j.filter("sign > 0"), "repressing": j.filter("sign < 0")}[mode]


def leading_members(sets: DataFrame, rankings: DataFrame, enriched: DataFrame, max_rank: int) -> DataFrame:
    """(set_id, motif, feature, rank): members of a set up to the rank at which its recovery curve is farthest above the
    mean curve of all motifs, for the enriched pairs (set_id, motif).

    Curves step at members only; the mean curve is counted once per set and rank over the motifs of `rankings`."""
    sets = sets.select("set_id", F.col("member").alias("feature")).distinct()
    hit = rankings.filter(F.col("rank") < max_rank).join(sets, "feature").select("set_id", "motif", "feature", "rank")
    n = rankings.agg(F.countDistinct("motif").alias("n__"))
    mean = hit.groupBy("set_id", "rank").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n))
    up = Window.partitionBy("set_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # at most max_rank rows
    mean = mean.select("set_id", "rank", (F.sum("c").over(up) / F.col("n__")).alias("mean"))
    own = Window.partitionBy("set_id", "motif").orderBy("rank", "feature").rowsBetween(Window.unboundedPreceding, 0)
    got = hit.join(enriched.select("set_id", "motif").distinct(), ["set_id", "motif"]).withColumn("got", F.count("*").over(own)).join(mean, ["set_id", "rank"])
    peak = got.groupBy("set_id", "motif").agg(F.min_by("rank", F.struct(-F.round(F.col("got") - F.col("mean"), 9), "rank")).alias("peak"))
    return got.join(peak, ["set_id", "motif"]).filter("rank <= peak").select("set_id", "motif", "feature", "rank")


def regulons(targets: DataFrame, enriched: DataFrame | None = None, min_genes: int = 10, add_tf: bool = True) -> DataFrame:
    """(set_id, member) named by factor and sign, of signed targets (tf, gene, sign), only those in `enriched` (tf, gene) if
    given, with the factor itself; smaller ones are left out."""
    t = targets.select("tf", "gene", "sign").distinct()
    t = t.join(enriched.select("tf", "gene").distinct(), ["tf", "gene"], "left_semi") if enriched is not None else t
    t = t.unionByName(t.select("tf", F.col("tf").alias("gene"), "sign")).distinct() if add_tf else t
    big = t.groupBy("tf", "sign").agg(F.count("*").alias("n")).filter(F.col("n") >= min_genes).drop("n")
    name = F.concat(F.col("tf").cast("string"), F.when(F.col("sign") > 0, "(+)").otherwise("(-)"))
    return t.join(big, ["tf", "sign"]).select(name.alias("set_id"), F.col("gene").alias("member"))


def vision(norm: DataFrame, sets: DataFrame, n_genes: int) -> DataFrame:
    """(cell, set_id, score) of signed sets (set_id, member, sign) for all cells with an expressed gene: the mean signed
    expression, less what a random signature of those signs would have in that cell, over its standard deviation."""
    cell = norm.groupBy("cell").agg((F.sum("norm") / n_genes).alias("mu"), (F.sum(F.col("norm") ** 2) / n_genes).alias("sq"))
    cell = cell.select("cell", "mu", F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mu") ** 2)).alias("sd"))
    sets = sets.select("set_id", F.col("member").alias("gene"), "sign").dropDuplicates(["set_id", "gene"])
    size = sets.groupBy("set_id").agg(F.count("*").alias("n"), F.sum("sign").alias("s"))
    got = norm.join(sets, "gene").groupBy("cell", "set_id").agg(F.sum(F.col("norm") * F.col("sign")).alias("got"))
    j = cell.join(size).join(got, ["cell", "set_id"], "left")  # as many rows as the result
    raw = F.coalesce("got", F.lit(0.0)) / F.col("n")
    return j.select("cell", "set_id", ((raw - F.col("mu") * F.col("s") / F.col("n")) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))).alias("score"))


def geary(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, c, consistency): Geary's C of scores (cell, set_id, score) over edges (src, dst, weight), and 1 - C."""
    m = scores.groupBy("set_id").agg(F.count("score").alias("n"), F.var_pop("score").alias("v"))
    a, b = scores.select(F.col("cell").alias("src"), "set_id", F.col("score").alias("x")), scores.select(F.col("cell").alias("dst"), "set_id", F.col("score").alias("y"))
    e = edges.select("src", "dst", "weight").join(a, "src").join(b, ["dst", "set_id"])
    s = e.groupBy("set_id").agg(F.sum(F.col("weight") * (F.col("x") - F.col("y")) ** 2).alias("d"), F.sum("weight").alias("w"))
    c = (F.col("n") - 1) * F.col("d") / F.nullif(2 * F.col("w") * F.col("n") * F.col("v"), F.lit(0.0))
    return s.join(m, "set_id").select("set_id", c.alias("c"), (1 - c).alias("consistency"))


def random_signatures(sets: DataFrame, genes: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """(draw, set_id, member, sign): for each set as many random signatures of its size and signs, genes drawn by a
    seeded hash."""
    need = sets.withColumn("at", F.row_number().over(Window.partitionBy("set_id").orderBy("member"))).select("set_id", "at", "sign")
    pool = genes.select("gene").distinct().crossJoin(F.broadcast(sets.select("set_id").distinct())).select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    key = F.md5(F.concat_ws("|", F.col("gene").cast("string"), "set_id", F.col("draw").cast("string"), F.lit(str(seed))))
    pool = pool.withColumn("at", F.row_number().over(Window.partitionBy("set_id", "draw").orderBy(key)))
    return pool.join(need, ["set_id", "at"]).select("draw", "set_id", F.col("gene").alias("member"), "sign")
