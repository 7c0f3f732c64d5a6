"""Single-cell operators over long counts (cell, gene, raw), zeros left out; obs (cell, ...) and var (gene, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranges import positions, tile
from helixframe.functions.ranks import bh_adjusted
from helixframe.functions.special import normal_tail
from helixframe.session import written


def quality_filter(counts: DataFrame, min_cells: int, min_lib_size: int, min_genes: int) -> DataFrame:
    """Counts of genes in enough cells, then of cells that pass on those genes alone."""
    genes = counts.groupBy("gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells).select("gene")
    left = counts.join(genes, "gene", "left_semi")
    cells = left.groupBy("cell").agg(F.sum("raw").alias("lib"), F.count("*").alias("nnz")).filter((F.col("lib") >= min_lib_size) & (F.col("nnz") >= min_genes)).select("cell")
    return left.join(cells, "cell", "left_semi")


def cell_metrics(counts: DataFrame) -> DataFrame:
    """(cell, nnz, lib_size)."""
    return counts.groupBy("cell").agg(F.count("*").alias("nnz"), F.sum("raw").alias("lib_size"))


def gene_metrics(counts: DataFrame) -> DataFrame:
    """(gene, n_cells, total)."""
    return counts.groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("raw").alias("total"))


def normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Adds norm = ln(1 + raw / library size * target). Library sizes come from a map-side sum, joined back by cell."""
    lib = counts.groupBy("cell").agg(F.sum("raw").alias("lib_size"))
    return counts.join(lib, "cell").select("cell", "gene", "raw", F.log1p(F.col("raw") / F.col("lib_size") * target).alias("norm"))


def clr(counts: DataFrame, features: int) -> DataFrame:
    """Adds clr, the centred log ratio of a cell over a panel of `features` with implicit zeros: ln(1 + raw) less its mean."""
    mean = counts.groupBy("cell").agg((F.sum(F.log1p("raw")) / features).alias("offset"))
    return counts.join(mean, "cell").select("cell", "gene", "raw", (F.log1p("raw") - F.col("offset")).alias("clr"))


def clr_offsets(counts: DataFrame, features: int) -> DataFrame:
    """(cell, offset): the mean of ln(1 + raw / library size) over all features."""
    lib = counts.groupBy("cell").agg(F.sum("raw").alias("lib_size"))
    return counts.join(lib, "cell").groupBy("cell").agg((F.sum(F.log1p(F.col("raw") / F.col("lib_size"))) / features).alias("offset"))


def top_gene_fractions(counts: DataFrame, tops: list[int]) -> DataFrame:
    """(cell, top_<n>...): share of a cell's counts in its n largest genes."""
    r = counts.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("raw"), "gene")))
    share = [(F.sum(F.when(F.col("rank") <= n, F.col("raw")).otherwise(0)) / F.sum("raw")).alias(f"top_{n}") for n in tops]
    return r.groupBy("cell").agg(*share)


def gene_set_fractions(counts: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, set_id, fraction) of pairs with a count."""
    lib = counts.groupBy("cell").agg(F.sum("raw").alias("lib_size"))
    held = counts.join(sets.select("set_id", F.col("member").alias("gene")).distinct(), "gene").groupBy("cell", "set_id").agg(F.sum("raw").alias("held"))
    return held.join(lib, "cell").select("cell", "set_id", (F.col("held") / F.col("lib_size")).alias("fraction"))


def mad_outliers(metrics: DataFrame, value: str, group: str | None = None, threshold: float = 3.0, direction: str = "twosided", scale: float = 1.4826) -> DataFrame:
    """Adds median, lower, upper and outlier per group. Medians are exact and found by two distributed aggregates."""
    rows = metrics.withColumn("g__", F.col(group) if group else F.lit(0))
    mid = rows.groupBy("g__").agg(F.percentile(value, F.lit(0.5)).alias("median"))
    dev = rows.join(mid, "g__").groupBy("g__", "median").agg((scale * threshold * F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5))).alias("off"))
    none = F.lit(None).cast("double")
    out = rows.join(dev, "g__").drop("g__")
    out = out.withColumn("lower", F.col("median") - F.col("off") if direction != "above" else none).withColumn("upper", F.col("median") + F.col("off") if direction != "below" else none)
    low = F.coalesce(F.col(value) < F.col("lower"), F.lit(False))
    high = F.coalesce(F.col(value) > F.col("upper"), F.lit(False))
    return out.withColumn("outlier", low | high).drop("off")


def group_outliers(metrics: DataFrame, value: str, group: str, threshold: float = 3.0, direction: str = "twosided") -> DataFrame:
    """(group, group_median, median, lower, upper, outlier): whole groups whose median deviates."""
    medians = metrics.groupBy(group).agg(F.percentile(value, F.lit(0.5)).alias("group_median"))
    return mad_outliers(medians, "group_median", None, threshold, direction)


def hard_flags(metrics: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """True where a metric is outside its (lower, upper) bounds."""
    out = F.lit(False)
    for name, (low, high) in bounds.items():
        for bad in ([F.col(name) < low] if low is not None else []) + ([F.col(name) > high] if high is not None else []):
            out = out | F.coalesce(bad, F.lit(False))
    return out


def grouped_gene_stats(norm: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """(group, gene, mean_expr, pct_expr) over all cells of a group, zeros included."""
    size = obs.groupBy(group).agg(F.count("*").alias("n_group"))
    g = norm.join(obs.select("cell", group), "cell").groupBy(group, "gene").agg(F.sum("norm").alias("s"), F.count("*").alias("c"))
    return g.join(F.broadcast(size), group).select(group, "gene", (F.col("s") / F.col("n_group")).alias("mean_expr"), (F.col("c") / F.col("n_group")).alias("pct_expr"))


def pseudobulk(norm: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """(group, gene, raw, norm): raw counts are summed, normalised ones averaged over all cells of the group."""
    size = obs.groupBy(group).agg(F.count("*").alias("n_group"))
    g = norm.join(obs.select("cell", group), "cell").groupBy(group, "gene").agg(F.sum("raw").alias("raw"), F.sum("norm").alias("s"))
    return g.join(F.broadcast(size), group).select(group, "gene", "raw", (F.col("s") / F.col("n_group")).alias("norm"))


def dispersion_hvg(counts: DataFrame, n_cells: int, top: int) -> DataFrame:
    """(gene, mean, variance, dispersion, is_hvg) with implicit zeros; the largest variance-to-mean ratios are variable."""
    x = F.col("raw").cast("double")
    g = counts.groupBy("gene").agg((F.sum(x) / n_cells).alias("mean"), (F.sum(x * x) / n_cells).alias("sq"))
    g = g.select("gene", "mean", (F.col("sq") - F.col("mean") * F.col("mean")).alias("variance"))
    g = g.withColumn("dispersion", F.col("variance") / F.col("mean"))
    best = g.orderBy(F.desc(F.round("dispersion", 9)), "gene").limit(top).select("gene", F.lit(True).alias("is_hvg"))
    return g.join(best, "gene", "left").withColumn("is_hvg", F.coalesce("is_hvg", F.lit(False)))


def _loess(x: np.ndarray, y: np.ndarray, span: float, n: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic fit with tricube weights at every x, or at those of the places `at`. With `n`, x is sorted and distinct
    and y the mean of as many points, which gives the fit of all of them."""
    if n is None:
        distinct, of, n = np.unique(x, return_inverse=True, return_counts=True)
        return _loess(distinct, np.bincount(of, weights=y) / n, span, n)[of]
    at = np.arange(len(x)) if at is None else at
    upto = np.cumsum(n)
    k = max(3, int(np.ceil(span * upto[-1]))) if upto[-1] >= 3 else int(upto[-1])
    k = min(k, int(upto[-1]))
    point = lambda j: x[np.searchsorted(upto, j, side="right")]  # noqa: E731  x of the point j, were each repeated n times
    # The k nearest points follow one another. They start no later than where their ends are as far from x on the right.
    low, high = np.zeros(len(at), np.int64), np.full(len(at), upto[-1] - k)
    while (low < high).any():
        middle = (low + high) // 2
        right = point(middle + k - 1) - x[at] >= x[at] - point(middle)
        right |= low == high
        low, high = np.where(right, low, middle + 1), np.where(right, middle, high)
    farthest = lambda j: np.maximum(np.abs(x[at] - point(j)), np.abs(point(j + k - 1) - x[at]))
    reach = np.minimum(farthest(low), farthest(np.maximum(low - 1, 0)))
    reach[reach == 0] = 1e-12
    out = np.empty(len(at))
    for i, (place, r) in enumerate(zip(at, reach, strict=True)):
        d = np.abs(x - x[place])
        near = d <= r
        w = ((1 - np.minimum(1, d[near] / r) ** 3) ** 3 + 1e-12) * n[near]
        a = np.vander(x[near] - x[place], 3, increasing=True) * np.sqrt(w)[:, None]
        out[i] = np.linalg.lstsq(a, y[near] * np.sqrt(w), rcond=None)[0][0]
    return out


def vst_hvg(counts: DataFrame, n_cells: int, top: int, span: float = 0.3) -> DataFrame:
    """(gene, mean, variance, variance_std, is_hvg): variance of counts standardised by the variance that a local fit of
    log variance on log mean expects, clipped at the square root of the number of cells.

    Moments are one aggregate, written once; the clipped sums are a second aggregate over the counts. Genes of one mean are
    one point of the fit, so points are at most as many as different totals of counts; places to fit at are dealt to tasks."""
    x = F.col("raw").cast("double")
    g = counts.groupBy("gene").agg((F.sum(x) / n_cells).alias("mean"), (F.sum(x * x) / n_cells).alias("sq"), F.count("*").alias("nnz"))
    g = written(g.select("gene", "mean", F.greatest(F.col("sq") - F.col("mean") ** 2, F.lit(0.0)).alias("variance"), "nnz"))
    points = g.filter("variance > 0").groupBy("mean").agg(F.count("*").alias("n"), F.avg(F.log10("variance")).alias("y")).orderBy("mean").toPandas()
    mean, n, y = points["mean"].to_numpy(np.float64), points["n"].to_numpy(np.int64), points["y"].to_numpy(np.float64)
    logs = np.log10(mean)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = pdf["id"].to_numpy()
            yield pd.DataFrame({"mean": mean[at], "expected_sd": np.sqrt(10 ** _loess(logs, y, span, n, at))})

    places = g.sparkSession.range(0, len(mean), 1, max(1, -(-len(mean) // 64)))
    expected = written(places.mapInPandas(fit, "mean double, expected_sd double"))
    fitted = g.withColumn("some__", F.when(F.col("variance") > 0, F.col("mean"))).join(F.broadcast(expected.withColumnRenamed("mean", "some__")), "some__", "left").drop("some__")
    bound = float(np.sqrt(n_cells))
    clip = lambda z: F.least(F.greatest(z, F.lit(-bound)), F.lit(bound))
    z = clip((F.col("raw") - F.col("mean")) / F.col("expected_sd"))
    sums = counts.join(fitted.select("gene", "mean", "expected_sd"), "gene").groupBy("gene").agg(F.sum(z).alias("s"), F.sum(z * z).alias("ss"))
    zero = clip(-F.col("mean") / F.col("expected_sd"))
    full = fitted.join(sums, "gene").withColumn("s", F.col("s") + (n_cells - F.col("nnz")) * zero).withColumn("ss", F.col("ss") + (n_cells - F.col("nnz")) * zero * zero)
    full = full.withColumn("variance_std", F.when(F.col("expected_sd") > 0, F.col("ss") / n_cells - (F.col("s") / n_cells) ** 2).otherwise(0.0))
    best = full.orderBy(F.desc("variance_std"), "gene").limit(top).select("gene", F.lit(True).alias("is_hvg"))
    return full.join(best, "gene", "left").select("gene", "mean", "variance", "variance_std", F.coalesce("is_hvg", F.lit(False)).alias("is_hvg"))


def combine_hvg(per_batch: DataFrame, top: int, how: str = "average") -> DataFrame:
    """(gene, n_batches, mean_score, is_hvg) of (batch, gene, score): `union` or `intersection` of each batch's best, or
    the best by average score."""
    r = per_batch.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc(F.round("score", 9)), "gene")))
    n = per_batch.agg(F.countDistinct("batch").alias("batches"))
    g = r.groupBy("gene").agg(F.count_if(F.col("rank") <= top).alias("n_batches"), F.avg("score").alias("mean_score")).crossJoin(F.broadcast(n))
    if how == "average":
        best = g.orderBy(F.desc(F.round("mean_score", 9)), "gene").limit(top).select("gene", F.lit(True).alias("is_hvg"))
        return g.join(best, "gene", "left").select("gene", "n_batches", "mean_score", F.coalesce("is_hvg", F.lit(False)).alias("is_hvg"))
    flag = F.col("n_batches") > 0 if how == "union" else F.col("n_batches") == F.col("batches")
    return g.select("gene", "n_batches", "mean_score", flag.alias("is_hvg"))


def markers(norm: DataFrame, obs: DataFrame, group: str, min_prop: float = 0.05, alternative: str = "greater") -> DataFrame:
    """(group, gene, lfc, prop1, prop2, z, p, fdr): Mann-Whitney of each group against the rest, for the alternative greater,
    less or twosided; the fdr is adjusted within a group over the genes that pass `min_prop`.

    Zeros are never made rows: the zeros of a gene are one block of ties with a known rank, so sums of ranks and the tie
    correction come from the expressed cells alone. Rest sums are totals minus the group's own."""
    sizes = obs.groupBy(group).agg(F.count("*").alias("n1"))
    total = obs.agg(F.count("*").alias("n"))
    x = norm.select("cell", "gene", "norm").join(obs.select("cell", group), "cell")
    by_value = x.groupBy("gene", "norm", group).agg(F.count("*").alias("c"))
    value = by_value.groupBy("gene", "norm").agg(F.sum("c").alias("t"))
    w = Window.partitionBy("gene").orderBy("norm").rowsBetween(Window.unboundedPreceding, -1)
    value = value.withColumn("below", F.coalesce(F.sum("t").over(w), F.lit(0)))
    per_gene = value.groupBy("gene").agg(F.sum("t").alias("nnz"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    placed = by_value.join(value, ["gene", "norm"]).groupBy("gene", group).agg(F.sum(F.col("c") * (F.col("below") + (F.col("t") + 1) / 2)).alias("r_expr"), F.sum("c").alias("c1"), F.sum(F.col("c") * F.expm1("norm")).alias("s1"))
    sums = placed.groupBy("gene").agg(F.sum("s1").alias("s_all"))
    every = placed.join(per_gene, "gene").join(sums, "gene").join(F.broadcast(sizes), group).crossJoin(F.broadcast(total))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2, zeros = n - n1, n - F.col("nnz")
    rank_sum = F.col("r_expr") + F.col("c1") * zeros + (n1 - F.col("c1")) * (zeros + 1) / 2
    u = rank_sum - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - (F.col("ties") + zeros ** 3 - zeros) / (n * (n - 1)))
    z = (u - n1 * n2 / 2) / F.sqrt(var)
    prop1, prop2 = F.col("c1") / n1, (F.col("nnz") - F.col("c1")) / n2
    lfc = F.log2((F.col("s1") / n1 + 1) / ((F.col("s_all") - F.col("s1")) / n2 + 1))
    out = every.filter((n1 > 0) & (n2 > 0)).select(group, "gene", lfc.alias("lfc"), prop1.alias("prop1"), prop2.alias("prop2"), z.alias("z"))
    z = F.col("z")
    p = {"greater": normal_tail(z), "less": normal_tail(-z), "twosided": F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))}[alternative]
    out = out.filter(F.greatest("prop1", "prop2") >= min_prop).withColumn("p", p)
    return out.withColumn("fdr", bh_adjusted(F.col("p"), [group], F.count("p").over(Window.partitionBy(group)), ["gene"]))  # a row a gene


def two_group_markers(norm: DataFrame, a: DataFrame, b: DataFrame, min_prop: float = 0.05, alternative: str = "twosided") -> DataFrame:
    """markers() of the cells of `a` against those of `b`, both (cell); a cell in both counts for `a`."""
    own = a.select("cell").distinct().withColumn("grp", F.lit("a"))
    obs = own.unionByName(b.select("cell").distinct().join(own, "cell", "left_anti").withColumn("grp", F.lit("b")))
    return markers(norm, obs, "grp", min_prop, alternative).filter("grp = 'a'").drop("grp")


def specific_markers(norm: DataFrame, obs: DataFrame, group: str) -> DataFrame:
    """(group, gene, auc_min, auc_median, auc_mean, rivals): the AUROC of a gene in a group against each other group.

    Counts below a value are running sums over the distinct values of a gene, a column for each group, so that counts are
    shuffled once, by gene; zeros are one block of ties of each group and never rows."""
    sizes = [(r[group], r["n"]) for r in obs.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()]  # groups are few
    if len(sizes) < 2:
        nothing = [F.lit(0.0).alias(c) for c in ("auc_min", "auc_median", "auc_mean")]
        return norm.join(obs, "cell").select(group, "gene", *nothing, F.lit(0).cast("long").alias("rivals")).limit(0)
    every, rivals = range(len(sizes)), len(sizes) - 1
    x = norm.select("cell", "gene", "norm").join(obs.select("cell", group), "cell").select("gene", "norm", group).repartition("gene")
    values = x.groupBy("gene", "norm").agg(*(F.count_if(F.col(group) == F.lit(sizes[i][0])).alias(f"c{i}") for i in every))
    whole = Window.partitionBy("gene")
    below = whole.orderBy("norm").rowsBetween(Window.unboundedPreceding, -1)
    level = lambda i: (F.coalesce(F.sum(f"c{i}").over(below), F.lit(0)) + F.col(f"c{i}") / 2).alias(f"b{i}")
    own = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("c")) for i in every))
    held = values.select("gene", own.alias("own"), *(level(i) for i in every), *(F.sum(f"c{i}").over(whole).alias(f"t{i}") for i in every))
    held = held.select("gene", F.explode(F.filter("own", lambda x: x["c"] > 0)).alias("own"), *(f"b{i}" for i in every), *(f"t{i}" for i in every))
    u = held.groupBy("gene", F.col("own.i").alias("i")).agg(F.sum("own.c").alias("nnz"), *(F.sum(F.col("own.c") * F.col(f"b{i}")).alias(f"u{i}") for i in every), *(F.first(f"t{i}").alias(f"t{i}") for i in every))
    names, n = F.array(*(F.lit(x) for x, _ in sizes)), F.array(*(F.lit(float(x)) for _, x in sizes))  # products of sizes outgrow integers
    u = u.select("gene", "i", F.col("nnz").cast("double").alias("nnz"), F.get(names, "i").alias(group), F.get(n, "i").alias("n"), *(f"u{i}" for i in every), *((F.lit(float(sizes[i][1])) - F.col(f"t{i}")).alias(f"z{i}") for i in every))
    auc = lambda i: F.when(F.col("i") != i, (F.col(f"u{i}") + F.col("nnz") * F.col(f"z{i}") + (F.col("n") - F.col("nnz")) * F.col(f"z{i}") / 2) / (F.col("n") * float(sizes[i][1])))
    u = u.withColumn("aucs", F.sort_array(F.array_compact(F.array(*(auc(i) for i in every)))))
    median = (F.get("aucs", F.lit((rivals - 1) // 2)) + F.get("aucs", F.lit(rivals // 2))) / 2
    mean = F.aggregate("aucs", F.lit(0.0), lambda s, x: s + x) / rivals
    return u.select(group, "gene", F.get("aucs", F.lit(0)).alias("auc_min"), median.alias("auc_median"), mean.alias("auc_mean"), F.lit(rivals).cast("long").alias("rivals"))


def rescued(flags: DataFrame, safe: dict[str, tuple[float | None, float | None]], flag: str = "outlier") -> DataFrame:
    """Flags of cells whose metrics all lie within the given (lower, upper) bounds become false."""
    return flags.withColumn(flag, F.col(flag) & hard_flags(flags, safe))


def isotype_controls(features: DataFrame, name: str = "gene", pattern: str = "isotype") -> DataFrame:
    """Adds is_isotype: whether a feature's name has the pattern, in either case."""
    return features.withColumn("is_isotype", F.coalesce(F.lower(F.col(name)).rlike(pattern.lower()), F.lit(False)))


def present_markers(lists: DataFrame, genes: DataFrame) -> DataFrame:
    """(cell_type, gene, sign) of marker lists (cell_type, positive, negative: arrays), only genes that are there."""
    each = lists.select("cell_type", F.explode("positive").alias("gene"), F.lit(1).alias("sign")).unionByName(lists.select("cell_type", F.explode("negative").alias("gene"), F.lit(-1).alias("sign")))
    return each.dropna().distinct().join(genes.select("gene").distinct(), "gene", "left_semi").select("cell_type", "gene", "sign")


def types_of_cells(scores: DataFrame, edges: DataFrame | None = None, own: float = 0.5) -> DataFrame:
    """(cell, cell_type, score, margin): the type with the best score (cell, cell_type, score) of each cell, and its lead
    over the second. With edges (src, dst, weight) scores are first mixed with the weighted mean over the neighbours of
    a cell, its own having the share `own`; a cell without edges keeps its scores."""
    s = scores.select("cell", "cell_type", "score")
    if edges is not None:
        total = edges.groupBy("src").agg(F.sum("weight").alias("t"))
        around = edges.join(s.withColumnRenamed("cell", "dst"), "dst").groupBy(F.col("src").alias("cell"), "cell_type").agg(F.sum(F.col("weight") * F.col("score")).alias("a"))
        j = s.join(around, ["cell", "cell_type"], "full").join(total.withColumnRenamed("src", "cell"), "cell", "left")
        mixed = own * F.coalesce("score", F.lit(0.0)) + (1 - own) * F.coalesce("a", F.lit(0.0)) / F.col("t")
        s = j.select("cell", "cell_type", F.when(F.col("t").isNull(), F.col("score")).otherwise(mixed).alias("score"))
    w = Window.partitionBy("cell").orderBy(F.desc(F.round("score", 9)), "cell_type")  # a row a type
    r = s.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return r.filter("r = 1").select("cell", "cell_type", "score", (F.col("score") - F.col("next")).alias("margin"))


def compactness(coordinates: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, n, compactness): variance of coordinates (id, embedding) within each group (id, group_id), averaged over
    the dimensions; 0 for lone members."""
    x = coordinates.join(groups, "id").select("group_id", "id", F.posexplode("embedding").alias("i", "x"))
    d = x.groupBy("group_id", "i").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return d.groupBy("group_id").agg(F.first("n").alias("n"), F.avg("v").alias("compactness"))


def separation(coordinates: DataFrame, groups: DataFrame, k: int = 1) -> DataFrame:
    """(group_id, separation): distance from a group's centre to the k-th nearest other centre."""
    from helixframe.operators.graphs import nearest_neighbours

    x = coordinates.join(groups, "id").select("group_id", F.posexplode("embedding").alias("i", "x")).groupBy("group_id", "i").agg(F.avg("x").alias("x"))
    centres = x.groupBy(F.col("group_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select(F.col("id").cast("long").alias("id"), F.col("s.x").alias("embedding"))
    return nearest_neighbours(centres, k).filter(F.col("rank") == k).select(F.col("id").alias("group_id"), F.col("distance").alias("separation"))


def module_scores(norm: DataFrame, sets: DataFrame, n_cells: int, bins: int = 24, controls: int = 100, seed: int = 42) -> DataFrame:
    """(cell, set_id, score): mean expression of a set less that of control genes drawn, by a seeded hash, from the
    expression bins of its members, weighted by how many members a bin has."""
    avg = norm.groupBy("gene").agg((F.sum("norm") / n_cells).alias("a"))
    placed = written(positions(avg, "a", "gene"))
    binned = placed.withColumn("bin", tile(F.col("position"), placed.count(), bins)).drop("position")
    sets = sets.select("set_id", F.col("member").alias("gene")).distinct().join(binned, "gene")
    need = sets.groupBy("set_id", "bin").agg(F.count("*").alias("members"))
    pool = need.join(binned.select("gene", "bin"), "bin").withColumn("i", F.row_number().over(Window.partitionBy("set_id", "bin").orderBy(F.md5(F.concat_ws("|", F.col("gene").cast("string"), "set_id", F.lit(str(seed)))), "gene"))).filter(F.col("i") <= controls)
    pool = pool.withColumn("w", F.col("members") / F.count("*").over(Window.partitionBy("set_id", "bin")))
    size = need.groupBy("set_id").agg(F.sum("members").alias("m"))
    weights = sets.select("set_id", "gene", F.lit(1.0).alias("w")).unionByName(pool.select("set_id", "gene", (-F.col("w")).alias("w")))
    weights = weights.groupBy("set_id", "gene").agg(F.sum("w").alias("w")).join(size, "set_id").select("set_id", "gene", (F.col("w") / F.col("m")).alias("w"))
    return norm.join(weights, "gene").groupBy("cell", "set_id").agg(F.sum(F.col("norm") * F.col("w")).alias("score"))


def type_scores(norm: DataFrame, markers_: DataFrame, n_cells: int) -> DataFrame:
    """(cell, cell_type, score) from markers (cell_type, gene, sign): z-scored expression of markers, weighted by how few
    types share them, over the root of their number."""
    types = markers_.agg(F.countDistinct("cell_type").alias("n_types"))
    sens = markers_.filter("sign > 0").groupBy("gene").agg(F.countDistinct("cell_type").alias("k")).crossJoin(F.broadcast(types))
    sens = sens.select("gene", F.when(F.col("n_types") > 1, 1 - (F.col("k") - 1) / (F.col("n_types") - 1)).otherwise(1.0).alias("w"))
    g = norm.groupBy("gene").agg((F.sum("norm") / n_cells).alias("mu"), F.sum(F.col("norm") ** 2).alias("ss"))
    g = g.withColumn("sd", F.sqrt((F.col("ss") - n_cells * F.col("mu") ** 2) / (n_cells - 1)))
    m = markers_.join(sens, "gene", "left").join(g, "gene").filter("sd > 0").withColumn("w", F.coalesce("w", F.lit(1.0)) * F.col("sign"))
    m = m.withColumn("root", F.sqrt(F.count("*").over(Window.partitionBy("cell_type", "sign"))))
    m = m.select("cell_type", "gene", (F.col("w") / F.col("root") / F.col("sd")).alias("w"), "mu")
    base = m.groupBy("cell_type").agg(F.sum(-F.col("mu") * F.col("w")).alias("base"))  # what a cell without any marker has
    got = norm.join(m, "gene").groupBy("cell", "cell_type").agg(F.sum(F.col("norm") * F.col("w")).alias("got"))
    return got.join(F.broadcast(base), "cell_type").select("cell", "cell_type", (F.col("got") + F.col("base")).alias("score"))


def assign_types(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, cell_type, total): the type with the largest summed score of each cluster (cell, cluster)."""
    g = scores.join(clusters, "cell").groupBy("cluster", "cell_type").agg(F.sum("score").alias("total"))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("total", 6)), "cell_type"))
    return g.withColumn("r", r).filter("r = 1").drop("r")


def purity(labels: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, top_label, purity, entropy) of the labels of each group."""
    c = labels.groupBy(group, label).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    c = c.withColumn("n", F.sum("c").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), label))).withColumn("share", F.col("c") / F.col("n"))
    return c.groupBy(group).agg(F.first("n").alias("n"), F.max(F.when(F.col("r") == 1, F.col(label))).alias("top_label"), F.max("share").alias("purity"), (-F.sum(F.col("share") * F.log("share"))).alias("entropy"))


def compositions(labels: DataFrame, sample: str, group: str) -> DataFrame:
    """(sample, group, n, share): counts of groups in samples, as for tests of differential abundance."""
    c = labels.groupBy(sample, group).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(sample)))


def size_order(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label, community): labels renumbered from 1 by descending size."""
    c = labels.groupBy(label).agg(F.count("*").alias("n"))
    return c.select(label, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), label)).alias("community"))


def doublet_rate(scores: DataFrame, threshold: float, sample: str = "sample") -> DataFrame:
    """(sample, n, n_doublets, rate) at a threshold of the score."""
    return scores.groupBy(sample).agg(F.count("*").alias("n"), F.count_if(F.col("score") > threshold).alias("n_doublets")).withColumn("rate", F.col("n_doublets") / F.col("n"))


def merge_experiments(parts: dict[str, DataFrame], how: str = "intersect") -> DataFrame:
    """Counts of several experiments with (exp_id, cell) prefixed; genes in all of them, or in any."""
    from functools import reduce

    tagged = [df.select(F.lit(k).alias("exp_id"), F.concat_ws("_", F.lit(k), F.col("cell").cast("string")).alias("cell"), "gene", "raw") for k, df in sorted(parts.items())]
    every = reduce(DataFrame.unionByName, tagged)
    if how != "intersect":
        return every
    shared = every.groupBy("gene").agg(F.countDistinct("exp_id").alias("k")).filter(F.col("k") == len(parts)).select("gene")
    return every.join(shared, "gene", "left_semi")


