"""Set enrichment: over-representation, elimination over an ontology, and rank-based scores of sets.

Sets are rows (set_id, member), targets rows (target_id, member), expression rows (sample, feature, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.digests import Texts
from helixframe.functions.ranges import positions
from helixframe.functions.ranks import average_rank, bh_adjusted
from helixframe.functions.special import hypergeometric_tail
from helixframe.session import cut, written


def hypergeometric(targets: DataFrame, sets: DataFrame, universe: DataFrame | None = None, min_overlap: int = 3, threshold: float | None = 0.05) -> DataFrame:
    """(target_id, set_id, hits, set_size, target_size, odds_ratio, pval, fdr) of pairs with enough hits and a small fdr.

    The universe defaults to all members of sets and targets. The fdr is adjusted per target over all sets before
    anything is filtered; sets without a hit have p = 1 and are counted without being paired. Only pairs that share a
    member are ever made."""
    targets, sets = targets.select("target_id", "member").dropna().distinct(), sets.select("set_id", "member").dropna().distinct()
    universe = (universe.select("member") if universe is not None else targets.select("member").unionByName(sets.select("member"))).distinct()
    targets, sets = targets.join(universe, "member", "left_semi"), sets.join(universe, "member", "left_semi")
    set_n = sets.groupBy("set_id").agg(F.count("*").alias("set_size"))
    target_n = targets.groupBy("target_id").agg(F.count("*").alias("target_size"))
    totals = F.broadcast(universe.agg(F.count("*").alias("universe_size")).crossJoin(set_n.agg(F.count("*").alias("n_sets"))))  # one row
    hits = targets.join(sets, "member").groupBy("target_id", "set_id").agg(F.count("*").alias("hits"))
    rows = hits.join(set_n, "set_id").join(target_n, "target_id").crossJoin(totals)
    h, m, k, n = (F.col(c) for c in ("hits", "set_size", "target_size", "universe_size"))
    rows = rows.withColumn("pval", hypergeometric_tail(h, m, n, k)).withColumn("odds_ratio", (h * (n - m - k + h)).cast("double") / F.nullif((k - h) * (m - h), F.lit(0)))
    rows = rows.withColumn("fdr", bh_adjusted(F.col("pval"), ["target_id"], F.col("n_sets"), ["set_id"]))
    kept = rows.filter(h >= min_overlap)
    if threshold is not None:
        kept = kept.filter(F.col("fdr") <= threshold)
    return kept.select("target_id", "set_id", "hits", "set_size", "target_size", "odds_ratio", "pval", "fdr")


def elimination(targets: DataFrame, terms: DataFrame, ancestry: DataFrame, levels: list[int], universe_size: int, min_overlap: int = 1, elim_threshold: float = 0.05) -> DataFrame:
    """Over-representation with elimination: (target_id, term, level, hits, term_size, pval).

    `terms` has (term, level, member), `ancestry` (term, ancestor). Levels are taken from the deepest up; the members of
    a significant term leave all its ancestors, for that target only. The loop has one step per level of the ontology."""
    from functools import reduce

    gone, done = None, []
    target_n = targets.groupBy("target_id").agg(F.countDistinct("member").alias("k"))
    for level in sorted(levels, reverse=True):
        mine = terms.filter(F.col("level") == level).select("term", "level", "member").distinct()
        size = mine.groupBy("term").agg(F.count("*").alias("all_size"))
        hit = targets.select("target_id", "member").distinct().join(mine, "member")
        lost = None
        if gone is not None:
            hit = hit.join(gone, ["target_id", "term", "member"], "left_anti")
            lost = gone.join(mine, ["term", "member"], "left_semi").groupBy("target_id", "term").agg(F.count("*").alias("lost"))
        n = hit.groupBy("target_id", "term", "level").agg(F.count("*").alias("hits")).join(size, "term").join(target_n, "target_id")
        n = n.join(lost, ["target_id", "term"], "left") if lost is not None else n.withColumn("lost", F.lit(0).cast("long"))
        n = n.withColumn("term_size", F.col("all_size") - F.coalesce("lost", F.lit(0)))
        n = n.withColumn("pval", hypergeometric_tail(F.col("hits"), F.col("term_size"), F.lit(universe_size), F.col("k")))
        n = cut(n.select("target_id", "term", "level", "hits", "term_size", "pval"))
        done.append(n)
        found = n.filter((F.col("pval") <= elim_threshold) & (F.col("hits") >= min_overlap)).select("target_id", "term")
        new = found.join(mine, "term").join(ancestry.filter("term <> ancestor"), "term").select("target_id", F.col("ancestor").alias("term"), "member").distinct()
        gone = cut(new if gone is None else gone.unionByName(new).distinct())
    return reduce(DataFrame.unionByName, done).filter(F.col("hits") >= min_overlap)


def _ranked(expr: DataFrame) -> DataFrame:
    """Adds rank (1 for the smallest) and n per sample, ties broken by feature."""
    w = Window.partitionBy("sample")
    return expr.withColumn("rank", F.row_number().over(w.orderBy("value", "feature"))).withColumn("n", F.count("*").over(w))


def ssgsea(expr: DataFrame, sets: DataFrame, alpha: float = 0.25) -> DataFrame:
    """(sample, set_id, score): the summed difference of the weighted and the plain running sums from the top rank down.

    A sample holds every feature once. The sums are closed forms over the members alone: a member at position i from the
    top adds its weight to all n - i + 1 later places, and each non-member its share likewise."""
    r = _ranked(expr).withColumn("at", F.col("n") - F.col("rank") + 1)
    hit = r.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature")
    wgt = F.pow(F.col("rank").cast("double"), F.lit(alpha))
    left = (F.col("n") - F.col("at") + 1).cast("double")
    g = hit.groupBy("sample", "set_id").agg((F.sum(wgt * left) / F.sum(wgt)).alias("up"), F.sum(left).alias("held"), F.count("*").alias("m"), F.first("n").alias("n"))
    down = (F.col("n") * (F.col("n") + 1) / 2 - F.col("held")) / (F.col("n") - F.col("m"))
    return g.filter("n > m").select("sample", "set_id", (F.col("up") - down).alias("score"))


def gsva(expr: DataFrame, sets: DataFrame, tau: float = 1.0, max_diff: bool = True, kernel: str = "none") -> DataFrame:
    """(sample, set_id, score) by the distribution of each feature over the samples, the empirical one or that of
    kernel_distribution(): features of a sample are
    ordered by it, far ranks weigh more, and the score is the sum of the largest deviations up and down of the running
    sum, or with `max_diff` false the larger of them. Both lie at members, so only members are scanned."""
    empirical = expr.select("sample", "feature", F.cume_dist().over(Window.partitionBy("feature").orderBy("value")).alias("d"))
    d = empirical if kernel == "none" else kernel_distribution(expr, kernel).withColumn("d", F.round("d", 9))
    w = Window.partitionBy("sample")
    r = d.select("sample", "feature", F.row_number().over(w.orderBy(F.desc("d"), "feature")).alias("at"), F.count("*").over(w).alias("n"))
    hit = r.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature").withColumn("x", F.pow(F.abs(F.col("n") / 2 - F.col("at") + 1), F.lit(tau)))
    own = Window.partitionBy("sample", "set_id")
    walk = hit.select("sample", "set_id", "at", "n", "x", F.sum("x").over(own.orderBy("at")).alias("c"), F.nullif(F.sum("x").over(own), F.lit(0.0)).alias("t"), F.count("*").over(own).alias("m"), F.row_number().over(own.orderBy("at")).alias("j")).filter("n > m")
    missed = (F.col("at") - F.col("j")) / (F.col("n") - F.col("m"))
    g = walk.groupBy("sample", "set_id").agg(F.greatest(F.lit(0.0), F.max(F.coalesce(F.col("c") / F.col("t"), F.lit(0.0)) - missed)).alias("up"), F.least(F.lit(0.0), F.min(F.coalesce((F.col("c") - F.col("x")) / F.col("t"), F.lit(0.0)) - missed)).alias("down"))
    larger = F.when(F.col("up") >= -F.col("down"), F.col("up")).otherwise(F.col("down"))
    return g.select("sample", "set_id", ((F.col("up") + F.col("down")) if max_diff else larger).alias("score"))


def singscore(expr: DataFrame, sets: DataFrame, centre: bool = True) -> DataFrame:
    """(sample, set_id, score, dispersion) of up-sets of known direction: the mean rank of members, scaled by its least
    and greatest possible value; the dispersion is 1.4826 times the median absolute deviation of ranks."""
    r = expr.withColumn("rank", F.rank().over(Window.partitionBy("sample").orderBy("value"))).withColumn("n", F.count("*").over(Window.partitionBy("sample")))
    hit = r.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature")
    hit = hit.withColumn("mid", F.percentile("rank", F.lit(0.5)).over(Window.partitionBy("sample", "set_id")))
    g = hit.groupBy("sample", "set_id").agg(F.avg("rank").alias("mean"), F.count("*").alias("m"), F.first("n").alias("n"), (1.4826 * F.percentile(F.abs(F.col("rank") - F.col("mid")), F.lit(0.5))).alias("dispersion"))
    low, high = (F.col("m") + 1) / 2, (2 * F.col("n") - F.col("m") + 1) / 2
    return g.filter("n > m").select("sample", "set_id", ((F.col("mean") - low) / (high - low) - (0.5 if centre else 0)).alias("score"), "dispersion")


def _members(sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """(set_id, feature) and what they are joined on: also the contrast, where sets have one."""
    on = [*(["contrast"] if "contrast" in sets.columns else []), "feature"]
    return sets.withColumnRenamed("member", "feature").select("set_id", *on).distinct(), on


def placed(stats: DataFrame) -> DataFrame:
    """(contrast, feature, stat, at, n), written: the place of each feature by descending statistic among the n of its
    contrast, found over ranges, so that no task holds a contrast."""
    key = F.when(F.isnan("stat"), 0).when(F.col("stat").isNotNull(), 1).otherwise(2)  # where a descending order has them
    whole = positions(stats.select("contrast", "feature", "stat", key.alias("kind__"), (-F.col("stat")).alias("less__")), "contrast", "kind__", "less__", "feature")
    first = whole.groupBy("contrast").agg((F.min("position") - 1).alias("before__"), F.count("*").alias("n"))  # a row a contrast
    return written(whole.join(F.broadcast(first), "contrast").select("contrast", "feature", "stat", (F.col("position") - F.col("before__")).alias("at"), "n"))


def gsea_statistic(stats: DataFrame, sets: DataFrame, power: float = 1.0, min_size: int = 5, max_size: int = 500, ranked: DataFrame | None = None) -> DataFrame:
    """(contrast, set_id, size, es): the largest deviation of the running sum over features by descending statistic.

    `stats` has (contrast, feature, stat). Extremes lie at members, so only members are scanned: just after one for the
    maximum, just before it for the minimum. Sets with a column `contrast` are those of that contrast alone. `ranked` is
    what placed() gives of the statistics, if it is at hand."""
    w = Window.partitionBy("contrast")
    ranked = ranked if ranked is not None else stats.withColumn("at", F.row_number().over(w.orderBy(F.desc("stat"), "feature"))).withColumn("n", F.count("*").over(w))
    own = Window.partitionBy("contrast", "set_id")
    hit = ranked.join(*_members(sets)).withColumn("m", F.count("*").over(own))
    return _extremes(hit.filter(F.col("m").between(min_size, max_size) & (F.col("m") < F.col("n"))), ["contrast"], power)


def _extremes(hit: DataFrame, by: list[str], power: float) -> DataFrame:
    """(by..., set_id, size, es) from members of sets with their place `at` among n features, m members a set."""
    own = Window.partitionBy(*by, "set_id")
    part = F.pow(F.abs("stat"), F.lit(power))
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hit = hit.withColumn("part", part / F.sum(part).over(own)).withColumn("run", F.sum("part").over(upto)).withColumn("i", F.row_number().over(own.orderBy("at")))
    miss = (F.col("at") - F.col("i")) / (F.col("n") - F.col("m"))
    g = hit.groupBy(*by, "set_id").agg(F.first("m").alias("size"), F.max(F.col("run") - miss).alias("high"), F.min(F.col("run") - F.col("part") - miss).alias("low"))
    es = F.when(F.col("high") > -F.col("low"), F.col("high")).when(F.col("high") < -F.col("low"), F.col("low")).otherwise(F.lit(0.0))
    return g.select(*by, "set_id", "size", es.alias("es"))


def gsea_permutations(stats: DataFrame, sets: DataFrame, permutations: int = 100, seed: int = 42, power: float = 1.0, min_size: int = 5, max_size: int | None = 500) -> DataFrame:
    """gsea_statistic() with pval: the share of permuted sets of the same sign at least as far, counting the real one.

    A permutation deals the statistics to features anew, by a seeded hash, as dealt_statistics() does. Values depend on the
    seed, not on the partitioning. No limit above the size of sets if `max_size` is None."""
    return _permuted_tests(written(stats), sets, permutations, seed, power, min_size, max_size)


#: Tasks that share the permutations of all contrasts, for each core: a task deals them one by one, so the statistics of a
#: contrast travel once a task, not once a permutation.
TASKS_A_CORE = 3


def _permuted_tests(stats: DataFrame, sets: DataFrame, permutations: int, seed: int, power: float, min_size: int, max_size: int | None) -> DataFrame:
    """See gsea_permutations(). A task has the features of a contrast, a few numbers each, and some permutations; it counts
    how often these are as far, so permuted statistics are never rows. `stats` is a written table, as it is read twice."""
    contrasts = stats.select("contrast").distinct().count()
    parts = max(1, min(permutations, -(-TASKS_A_CORE * stats.sparkSession.sparkContext.defaultParallelism // max(1, contrasts))))
    members, on = _members(sets)
    codes = positions(members.select("set_id").distinct(), "set_id")
    held = members.join(codes, "set_id").groupBy(*on).agg(F.collect_list(F.col("position").cast("int")).alias("codes"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    rows = stats.join(held.hint("merge"), on, "left").select("contrast", "feature", F.col("feature").cast("string").alias("name"), F.col("stat").cast("double").alias("stat"), "codes", every)

    def run(table: pa.Table) -> pa.Table:
        return _dealt_tests(table, permutations, parts, seed, power, min_size, max_size)

    kind = stats.schema["contrast"].dataType.simpleString()
    done = rows.groupBy("contrast", "part").applyInArrow(run, f"contrast {kind}, position long, size long, es double, far long, same long")
    counted = done.groupBy("contrast", "position").agg(F.max("size").alias("size"), F.max("es").alias("es"), F.sum("far").alias("far"), F.sum("same").alias("same"))
    return counted.join(codes, "position").select("contrast", "set_id", "size", "es", ((F.col("far") + 1) / (F.col("same") + 1)).alias("pval"))


def _dealt_tests(table: pa.Table, permutations: int, parts: int, seed: int, power: float, min_size: int, max_size: int | None) -> pa.Table:
    """(contrast, position, size, es, far, same) of one contrast: its sets by their number, and of this part's permutations
    how many have the sign and how many are also as far."""
    part, contrast = table.column("part")[0].as_py(), table.column("contrast").slice(0, 1)
    table = table.select(["feature", "name", "stat", "codes"]).take(pc.sort_indices(table.column("feature")))  # the order of ties
    n, names = len(table), Texts(table.column("name"))
    stat = table.column("stat").to_numpy().astype(np.float64)
    lists = table.column("codes").combine_chunks()
    code = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    feature = np.repeat(np.arange(n), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
    size = np.bincount(code) if len(code) else np.zeros(0, np.int64)
    fine = (size >= max(1, min_size)) & (size <= (n if max_size is None else max_size)) & (size < n)
    numbers = np.flatnonzero(fine)
    kept = fine[code]
    code, feature = (np.cumsum(fine) - 1)[code[kept]], feature[kept]
    size = size[numbers]
    ends = np.concatenate([[0], np.cumsum(size)])
    first, before = np.repeat(np.arange(len(size)) * n, size), np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    others = np.repeat(n - size, size).astype(np.float64)
    by = np.argsort(-stat, kind="stable")  # places by descending statistic
    level = np.concatenate([[0], np.cumsum(stat[by][1:] != stat[by][:-1])]) * n  # places that tie
    weight = np.abs(stat[by]) ** power

    def scores(features: np.ndarray) -> np.ndarray:
        """Of all sets, the features being in the order of their places."""
        at = np.empty(n, np.int64)
        at[features] = np.arange(n)
        place = np.sort(code * n + at[feature]) - first
        share, run = weight[place], np.empty(len(place))
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            np.cumsum(share[a:z], out=run[a:z])
        total = np.repeat(np.maximum(run[ends[1:] - 1], 1e-300), size)
        run, share = run / total, share / total
        run -= (place - before) / others
        high, low = np.maximum.reduceat(run, ends[:-1]), np.minimum.reduceat(run - share, ends[:-1])
        return np.where(high > -low, high, np.where(high < -low, low, 0.0))

    far = same = np.zeros(len(size), np.int64)
    es = np.zeros(0)
    if len(size):
        es = scores(by)
        for turn in range(part + 1, permutations + 1, parts):
            key = names.digests(f"|{turn}|{seed}".encode())
            top = np.ascontiguousarray(key[:, 0])
            order = np.argsort(top)
            if (top[order][1:] == top[order][:-1]).any():
                order = np.lexsort((key[:, 1], top))
            null = scores(np.sort(level + order) - level)
            alike = np.sign(null) == np.sign(es)
            same = same + alike
            far = far + (alike & (np.abs(null) >= np.abs(es)))
    told = pa.concat_arrays([contrast.combine_chunks()]).take(pa.array(np.zeros(len(size), np.int64)))
    return pa.table({"contrast": told, "position": numbers, "size": size.astype(np.int64), "es": es, "far": far, "same": same})


def aucell(counts: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """(cell, set_id, auc): area under the recovery curve of a set within the `top` expressed genes of a cell, over the
    largest area that the set could have. Ties go to the smaller gene."""
    r = counts.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("raw"), "gene"))).filter(F.col("rank") < top)
    sets = sets.select("set_id", F.col("member").alias("gene")).distinct()
    size = sets.groupBy("set_id").agg(F.count("*").alias("m"))
    g = r.join(sets, "gene").groupBy("cell", "set_id").agg(F.sum(F.lit(top) - F.col("rank")).alias("area")).join(size, "set_id")
    m = F.least(F.col("m"), F.lit(top - 1))
    return g.select("cell", "set_id", (F.col("area") / (m * top - m * (m + 1) / 2)).alias("auc"))


def mitch(stats: DataFrame, sets: DataFrame, min_size: int = 5) -> DataFrame:
    """(contrast, set_id, size, s): difference of mean ranks in and out of a set, over half the number of features."""
    r = stats.withColumn("rank", average_rank(["contrast"], F.col("stat"))).withColumn("n", F.count("*").over(Window.partitionBy("contrast")))
    total = (F.col("n") * (F.col("n") + 1) / 2).cast("double")
    g = r.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature").groupBy("contrast", "set_id").agg(F.count("*").alias("size"), F.sum("rank").alias("held"), F.first("n").alias("n")).filter((F.col("size") >= min_size) & (F.col("size") < F.col("n")))
    s = 2 * (F.col("held") / F.col("size") - (total - F.col("held")) / (F.col("n") - F.col("size"))) / F.col("n")
    return g.select("contrast", "set_id", "size", s.alias("s"))


def recovery_enrichment(sets: DataFrame, rankings: DataFrame, max_rank: int, min_nes: float | None = None) -> DataFrame:
    """(set_id, motif, auc, nes) from rankings (motif, feature, rank from 1): recovery of a set within max_rank, and its
    z-score over motifs."""
    sets = sets.select("set_id", F.col("member").alias("feature")).distinct()
    hit = rankings.filter(F.col("rank") < max_rank).join(sets, "feature").groupBy("set_id", "motif").agg(F.sum(F.lit(max_rank) - F.col("rank")).alias("area"))
    size = sets.groupBy("set_id").agg(F.count("*").alias("m"))
    every = size.crossJoin(rankings.select("motif").distinct())  # as many rows as the result, zeros count in the z-scores
    auc = every.join(hit, ["set_id", "motif"], "left").withColumn("auc", F.coalesce("area", F.lit(0)) / (F.col("m") * F.lit(max_rank)))
    w = Window.partitionBy("set_id")
    out = auc.withColumn("nes", (F.col("auc") - F.avg("auc").over(w)) / F.nullif(F.stddev_samp("auc").over(w), F.lit(0.0))).select("set_id", "motif", "auc", "nes")
    return out.filter(F.col("nes") >= min_nes) if min_nes is not None else out


def rank_matrix(expr: DataFrame, stable: DataFrame | None = None) -> DataFrame:
    """(sample, feature, rank): ranks from 1 in ascending order, ties sharing the smallest. With stable features (feature)
    the rank is the share of them, within the sample, whose value is not above."""
    if stable is None:
        return expr.select("sample", "feature", F.rank().over(Window.partitionBy("sample").orderBy("value")).alias("rank"))
    mark = expr.join(stable.select("feature").distinct().withColumn("ref", F.lit(1)), "feature", "left")
    upto = Window.partitionBy("sample").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("sample")
    ref = F.coalesce("ref", F.lit(0))
    return mark.select("sample", "feature", (F.sum(ref).over(upto) / F.nullif(F.sum(ref).over(all_), F.lit(0))).alias("rank"))


def singscore_two_sided(expr: DataFrame, up: DataFrame, down: DataFrame, centre: bool = True, known_direction: bool = True) -> DataFrame:
    """(sample, set_id, up_score, down_score, score): scores of up-sets by ascending and of down-sets by descending ranks,
    and their sum; sets (set_id, member) that have only one side score by that. Without a known direction distances of
    ranks from the middle are scored, and only of up-sets."""
    w = Window.partitionBy("sample")
    r = expr.select("sample", "feature", F.rank().over(w.orderBy("value")).alias("low"), F.rank().over(w.orderBy(F.desc("value"))).alias("high"), F.count("*").over(w).alias("n"))

    def side(sets: DataFrame, rank: str, name: str) -> DataFrame:
        hit = r.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature")
        x = F.col(rank) if known_direction else F.abs(F.col(rank) - F.ceil(F.col("n") / 2))
        g = hit.groupBy("sample", "set_id").agg(F.avg(x).alias("mean"), F.count("*").cast("double").alias("m"), F.first("n").alias("n")).filter("n > m")
        if known_direction:
            low, high = (F.col("m") + 1) / 2, (2 * F.col("n") - F.col("m") + 1) / 2
        else:
            low = (F.ceil(F.col("m") / 2) + 1) / 2
            high = (F.col("n") - F.ceil(F.col("m") / 2) + 1) / 2
        return g.select("sample", "set_id", ((F.col("mean") - low) / (high - low) - (0.5 if centre and known_direction else 0)).alias(name))

    if not known_direction:
        return side(up, "low", "up_score").select("sample", "set_id", "up_score", F.lit(None).cast("double").alias("down_score"), F.col("up_score").alias("score"))
    j = side(up, "low", "up_score").join(side(down, "high", "down_score"), ["sample", "set_id"], "full")
    return j.select("sample", "set_id", "up_score", "down_score", (F.coalesce("up_score", F.lit(0.0)) + F.coalesce("down_score", F.lit(0.0))).alias("score"))


def singscore_permutations(expr: DataFrame, sets: DataFrame, permutations: int = 100, seed: int = 42) -> DataFrame:
    """(sample, set_id, score, pval): share of random sets of the same size, drawn by a seeded hash, that score as high,
    counting the real one. Draws depend on the size alone, so sets of one size share them."""
    real = singscore(expr, sets).select("sample", "set_id", "score")
    features = expr.select("feature").distinct()
    sizes = sets.join(features.withColumnRenamed("feature", "member"), "member", "left_semi").distinct().groupBy("set_id").agg(F.count("*").alias("m"))
    key = F.md5(F.concat_ws("|", F.col("feature").cast("string"), F.col("draw").cast("string"), F.lit(str(seed))))
    order = features.select("feature", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("draw")).withColumn("at", F.row_number().over(Window.partitionBy("draw").orderBy(key)))
    w = Window.partitionBy("sample")
    r = expr.select("sample", "feature", F.rank().over(w.orderBy("value")).alias("rank"), F.count("*").over(w).alias("n"))
    # The mean rank of the first m features of a draw, for each size m that occurs.
    most = sizes.agg(F.max("m")).first()[0] or 0
    run = r.join(order.filter(F.col("at") <= most), "feature")
    upto = Window.partitionBy("sample", "draw").orderBy("at")
    run = run.select("sample", "draw", F.row_number().over(upto).alias("m"), "n", F.avg("rank").over(upto.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))
    null = run.join(F.broadcast(sizes.select("m").distinct()), "m").filter("n > m")
    low, high = (F.col("m") + 1) / 2, (2 * F.col("n") - F.col("m") + 1) / 2
    null = null.select("sample", "m", ((F.col("mean") - low) / (high - low) - 0.5).alias("null_score"))
    j = real.join(sizes, "set_id").join(null, ["sample", "m"])
    return j.groupBy("sample", "set_id", "score").agg(((F.count_if(F.col("null_score") >= F.col("score")) + 1) / (F.count("*") + 1)).alias("pval"))


def set_positions(stats: DataFrame, sets: DataFrame, min_size: int = 5, max_size: int = 500) -> DataFrame:
    """(contrast, set_id, size, positions): places of a set's members in the order of descending statistics, from 1."""
    at = F.row_number().over(Window.partitionBy("contrast").orderBy(F.desc("stat"), "feature"))
    hit = stats.withColumn("at", at).join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature")
    g = hit.groupBy("contrast", "set_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("at")).alias("positions"))
    return g.filter(F.col("size").between(min_size, max_size))


def normalised_enrichment(real: DataFrame, null: DataFrame) -> DataFrame:
    """(contrast, set_id, es, nes, pval, fdr) of statistics (contrast, set_id, es) against permuted ones (contrast, set_id,
    null_es): nes over the mean of permuted ones of its sign, the fdr adjusted per contrast."""
    j = real.join(null, ["contrast", "set_id"], "left")
    same = F.signum("null_es") == F.signum("es")
    g = j.groupBy("contrast", "set_id", "es").agg(F.avg(F.when(same, F.abs("null_es"))).alias("m"), ((F.count_if(same & (F.abs("null_es") >= F.abs("es"))) + 1) / (F.count_if(same) + 1)).alias("pval"))
    g = g.withColumn("nes", F.col("es") / F.nullif("m", F.lit(0.0)))
    return g.withColumn("fdr", bh_adjusted(F.col("pval"), ["contrast"], F.count("pval").over(Window.partitionBy("contrast")), ["set_id"])).select("contrast", "set_id", "es", "nes", "pval", "fdr")


def dealt_statistics(stats: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(contrast, perm, feature, stat, at): statistics dealt to features anew, by a seeded hash, and their places by
    descending statistic. A permutation is shuffled once, as names and as values; hashes are made where they are sorted."""
    every = F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm")
    together = lambda t: t.select("*", every).repartition("contrast", "perm")
    w = Window.partitionBy("contrast", "perm")
    key = F.md5(F.concat_ws("|", F.col("feature").cast("string"), F.col("perm").cast("string"), F.lit(str(seed))))
    down = F.row_number().over(Window.partitionBy("contrast").orderBy(F.desc("stat"), "feature"))
    names = together(stats.select("contrast", "feature")).withColumn("at", F.row_number().over(w.orderBy(key, "feature")))
    values = together(stats.select("contrast", "stat", down.alias("at")))
    shuffled = names.join(values, ["contrast", "perm", "at"]).drop("at")
    return shuffled.select("contrast", "perm", "feature", "stat", F.row_number().over(w.orderBy(F.desc("stat"), "feature")).alias("at"))


def permuted_statistics(stats: DataFrame, sets: DataFrame, permutations: int, seed: int = 42, power: float = 1.0, min_size: int = 5, max_size: int = 500, dealt: DataFrame | None = None) -> DataFrame:
    """(contrast, set_id, null_es) of dealt_statistics(); see gsea_permutations(). A permutation changes neither the size of
    a set nor the number of features, so only members of sets that count meet permutations."""
    dealt = dealt_statistics(stats, permutations, seed) if dealt is None else dealt
    n = stats.groupBy("contrast").agg(F.count("*").alias("n"))
    held = stats.select("contrast", "feature").join(*_members(sets)).withColumn("m", F.count("*").over(Window.partitionBy("contrast", "set_id")))
    held = held.join(F.broadcast(n), "contrast").filter(F.col("m").between(min_size, max_size) & (F.col("m") < F.col("n")))  # a row a contrast
    hit = dealt.join(held.select("contrast", "feature", "set_id", "m", "n"), ["contrast", "feature"])
    return _extremes(hit, ["contrast", "perm"], power).select("contrast", "set_id", F.col("es").alias("null_es"))


def gsea_leading_edge(stats: DataFrame, sets: DataFrame, power: float = 1.0, min_size: int = 5, max_size: int = 500) -> DataFrame:
    """(contrast, set_id, feature, at): members up to the maximum of the running sum where that is the larger deviation,
    from the minimum on where that is; none where both are equal."""
    w = Window.partitionBy("contrast")
    ranked = stats.withColumn("at", F.row_number().over(w.orderBy(F.desc("stat"), "feature"))).withColumn("n", F.count("*").over(w))
    own = Window.partitionBy("contrast", "set_id")
    hit = ranked.join(sets.select("set_id", F.col("member").alias("feature")).distinct(), "feature").withColumn("m", F.count("*").over(own))
    hit = hit.filter(F.col("m").between(min_size, max_size) & (F.col("m") < F.col("n")))
    x = F.pow(F.abs("stat"), F.lit(power))
    hit = hit.withColumn("part", x / F.sum(x).over(own)).withColumn("i", F.row_number().over(own.orderBy("at")))
    miss = (F.col("at") - F.col("i")) / (F.col("n") - F.col("m"))
    high = F.sum("part").over(own.orderBy("at")) - miss
    hit = hit.withColumn("high", F.round(high, 12)).withColumn("low", F.round(F.col("high") - F.col("part"), 12))
    up, down = F.max("high").over(own), F.min("low").over(own)
    hit = hit.withColumn("up", up).withColumn("down", down)
    peak_up = F.min(F.when(F.col("high") == F.col("up"), F.col("at"))).over(own)
    peak_down = F.max(F.when(F.col("low") == F.col("down"), F.col("at"))).over(own)
    hit = hit.withColumn("pu", peak_up).withColumn("pd", peak_down)
    edge = ((F.col("up") > -F.col("down")) & (F.col("at") <= F.col("pu"))) | ((F.col("up") < -F.col("down")) & (F.col("at") >= F.col("pd")))
    return hit.filter(edge).select("contrast", "set_id", "feature", "at")


def gsea_elimination(stats: DataFrame, terms: DataFrame, ancestry: DataFrame, levels: list[int], permutations: int = 100, elim_threshold: float = 0.05, min_size: int = 5, max_size: int | None = 500, seed: int = 42) -> DataFrame:
    """(contrast, term, level, size, es, pval): gsea_permutations() from the deepest level up; the members of a significant
    term leave all its ancestors, in that contrast only. One step per level of the ontology."""
    from functools import reduce

    stats = written(stats)
    contrasts = F.broadcast(written(stats.select("contrast").distinct()))  # a row a contrast
    gone, done = None, []
    for level in sorted(levels, reverse=True):
        mine = terms.filter(F.col("level") == level).select(F.col("term").alias("set_id"), "member").distinct()
        own = mine.crossJoin(contrasts).select("contrast", "set_id", "member")
        own = own.join(gone.hint("merge"), ["contrast", "set_id", "member"], "left_anti") if gone is not None else own
        n = _permuted_tests(stats, own, permutations, seed, 1.0, min_size, max_size)
        n = cut(n.select("contrast", F.col("set_id").alias("term"), F.lit(level).alias("level"), "size", "es", "pval"))
        done.append(n)
        found = n.filter(F.col("pval") <= elim_threshold).select("contrast", F.col("term").alias("set_id"))
        new = found.join(mine, "set_id").join(ancestry.filter("term <> ancestor").withColumnRenamed("term", "set_id"), "set_id").select("contrast", F.col("ancestor").alias("set_id"), "member").distinct()
        gone = cut(new if gone is None else gone.unionByName(new).distinct())
    return reduce(DataFrame.unionByName, done)


def kernel_distribution(expr: DataFrame, kernel: str = "gaussian") -> DataFrame:
    """(sample, feature, d): the kernel estimate of a feature's distribution over the samples at its own value. `gaussian`
    has a bandwidth of a quarter of the standard deviation, `poisson` takes counts with rate value + 0.5. Values meet
    within a feature only: samples squared rows a feature, reduced where they are made."""
    from helixframe.functions.special import lgamma, normal_tail

    sd = expr.groupBy("feature").agg(F.coalesce(F.nullif(F.stddev_samp("value") / 4, F.lit(0.0)), F.lit(0.001)).alias("h"))
    a = expr.select("sample", "feature", F.col("value").alias("x")).join(sd, "feature")
    b = expr.select("feature", F.col("value").alias("y"))
    if kernel == "gaussian":
        p = normal_tail((F.col("y") - F.col("x")) / F.col("h"))
    elif kernel == "poisson":
        rate = F.col("y") + 0.5
        terms = F.transform(F.sequence(F.lit(0), F.floor("x").cast("int")), lambda k: F.exp(k * F.log(rate) - rate - lgamma(k + 1)))
        p = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)
    else:
        raise ValueError(kernel)
    return a.join(b, "feature").groupBy("sample", "feature").agg(F.avg(p).alias("d"))
