"""Agglomerative trees of features, built by joins, and where to cut them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import sweep, tables, written


def _joined(linkage: str, d1: Column, d2: Column, between: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Distance of a cluster of n from the union of two of n1 and n2."""
    if linkage == "ward":
        return ((n1 + n) * d1 + (n2 + n) * d2 - n * between) / (n1 + n2 + n)
    return {"average": (n1 * d1 + n2 * d2) / (n1 + n2), "complete": F.greatest(d1, d2), "single": F.least(d1, d2)}[linkage]


def _half(d: DataFrame, part: DataFrame, linkage: str) -> DataFrame:
    """Pairs (b, a, d, nb, na) of (a, b, d, na, nb), turned round, with the clusters a merged as `part` says."""
    rows = d.join(part.withColumnRenamed("node", "a"), "a", "left").filter("low is null or (b <> low and b <> high)")
    to = F.coalesce("low", "a")
    d1, d2 = F.max(F.when(F.col("a") == to, F.col("d"))), F.max(F.when(F.col("a") != to, F.col("d")))
    g = rows.groupBy(to.alias("u"), "b").agg(d1.alias("d1"), d2.alias("d2"), *(F.max(c).alias(c) for c in ("between", "n1", "n2", "na", "nb")))
    new = F.when(F.col("d2").isNull(), F.col("d1")).otherwise(_joined(linkage, *map(F.col, ("d1", "d2", "between", "n1", "n2", "nb"))))
    return g.select(F.col("b").alias("a"), F.col("u").alias("b"), new.alias("d"), F.col("nb").alias("na"), F.when(F.col("d2").isNull(), F.col("na")).otherwise(F.col("n1") + F.col("n2")).alias("nb"))


def agglomerated(pairs: DataFrame, linkage: str = "average") -> DataFrame:
    """(a, b, height, size, step) of the merges of all nodes of `pairs` (a, b, distance), each pair given once: clusters are
    named by their smallest node, b is merged into a, and steps count by height from 1.

    Clusters that are nearest to one another merge, all such pairs of a round at once; for these linkages (average,
    complete, single, ward) that gives the tree of merging one pair after another. Distances to merged clusters follow from
    those to their parts, first for one side of the table of pairs, then for the other; a round is a few joins and sums on
    pairs of clusters, and nothing is gathered. Ties go to the pair with the smaller names. The table holds all pairs of
    nodes, which is what these linkages are defined on."""
    before = tables()
    spark = pairs.sparkSession
    one = pairs.filter("a <> b").select("a", "b", F.col("distance").cast("double").alias("d"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    d = written(both.groupBy("a", "b").agg(F.min("d").alias("d"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    merges = []
    while d.head(1):
        first = F.col("a") < F.col("b")
        low, high = F.struct("a", "na"), F.struct("b", "nb")
        order = F.struct("d", F.when(first, low).otherwise(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"))).alias("low"), F.when(first, high).otherwise(F.struct(F.col("a").alias("b"), F.col("na").alias("nb"))).alias("high"))
        near = d.groupBy("a").agg(F.min(order).alias("x")).select("x.low", "x.high", "x.d")
        mutual = near.groupBy("low", "high").agg(F.count("*").alias("votes"), F.min("d").alias("between")).filter("votes = 2")
        own = written(mutual.select(F.col("low.a").alias("low"), F.col("high.b").alias("high"), "between", F.col("low.na").alias("n1"), F.col("high.nb").alias("n2")))
        merges.append(own.select(F.col("low").alias("a"), F.col("high").alias("b"), F.col("between").alias("height"), (F.col("n1") + F.col("n2")).alias("size")))
        part = own.select("low", "high", F.explode(F.array("low", "high")).alias("node"), "between", "n1", "n2")
        # One side of the table, then the other: rows of both parts become the row of their union.
        d = written(_half(_half(d, part, linkage), part, linkage))
    if not merges:
        kind = pairs.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"a {kind}, b {kind}, height double, size long, step int")
    out = merges[0]
    for m in merges[1:]:
        out = out.unionByName(m)
    step = F.row_number().over(Window.partitionBy().orderBy("height", "size", "a", "b"))  # a row a node
    out = written(out.withColumn("step", step))
    sweep(spark, before, out)
    return out


def cut_trees(merges: DataFrame, ks: list[int]) -> DataFrame:
    """(k, node, label): the tree of agglomerated() cut into each of `ks` clusters; a label is the smallest node.

    Merges up to the largest k are followed from node to cluster by doubling pointers; the few above it are followed for
    each k from the labels there, which are at most max(ks)."""
    top = max(ks)
    n = merges.count() + 1
    link = merges.filter(F.col("step") <= n - top).select(F.col("b").alias("node"), F.col("a").alias("to"))
    nodes = merges.select(F.col("a").alias("node")).union(merges.select("b")).distinct()
    state = written(nodes.join(link, "node", "left").select("node", F.coalesce("to", "node").alias("label")))
    while True:
        jump = state.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(state.join(jump, "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")))
        state = new.select("node", "label")
        if not new.filter("moved").head(1):
            break
    last = merges.filter(F.col("step") > n - top).orderBy("step").select("a", "b", "step").collect()  # fewer than max(ks)
    names = [r["label"] for r in state.select("label").distinct().collect()]  # at most max(ks)
    at, rows = {x: x for x in names}, []
    for k in range(top, 0, -1):
        if k in ks:
            rows += [(k, x, to) for x, to in at.items()]
        if last:
            r = last.pop(0)
            at = {x: r["a"] if to == r["b"] else to for x, to in at.items()}
    kind = merges.schema["a"].dataType.simpleString()
    told = merges.sparkSession.createDataFrame(rows, f"k int, label {kind}, to {kind}")
    return state.join(told, "label").select("k", "node", F.col("to").alias("label"))


def cut_quality(labels: DataFrame, correlations: DataFrame) -> DataFrame:
    """(k, label, size, r2) of labels (k, node, label): the median squared correlation (f1, f2, cor) of the pairs inside a
    cluster, null for single nodes. Pairs that have no row count as uncorrelated."""
    of = lambda c, l: labels.select("k", F.col("node").alias(c), F.col("label").alias(l))
    size = labels.groupBy("k", "label").agg(F.count("*").alias("size"))
    inner = correlations.join(of("f1", "a"), "f1").join(of("f2", "b").withColumnRenamed("k", "k2"), "f2").filter("k = k2 and a = b and f1 <> f2")
    r2 = inner.groupBy("k", F.col("a").alias("label")).agg(F.array_sort(F.collect_list(F.col("cor") ** 2)).alias("all"))
    pairs = (F.col("size") * (F.col("size") - 1) / 2).cast("long")
    # The absent pairs are zeros before all others.
    at = lambda i: F.coalesce(F.get("all", (i - 1 - (pairs - F.size("all"))).cast("int")), F.lit(0.0))
    median = (at(F.floor((pairs + 1) / 2)) + at(F.floor((pairs + 2) / 2))) / 2
    j = size.join(r2, ["k", "label"], "left").withColumn("all", F.coalesce("all", F.array().cast("array<double>")))
    return j.select("k", "label", "size", F.when(pairs > 0, median).alias("r2"))


def turning_point(ks: list[int], values: list[float], span: float = 0.3) -> int:
    """The k at which the slope of the curve falls most, after local lines with tricube weights over a part of the points."""
    x, y = np.array(ks, float), np.array(values, float)
    if len(x) < 4:
        return ks[int(np.argmax(y))]
    m, smooth = max(3, int(np.ceil(span * len(x)))), []
    for v in x:
        far = np.abs(x - v)
        h = max(np.sort(far)[m - 1], 1e-12)
        w = np.clip(1 - (far / (1.0001 * h)) ** 3, 0, None) ** 3
        a = np.stack([np.ones_like(x), x - v], axis=1)
        smooth.append(np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0])
    slope = np.diff(smooth) / np.diff(x)
    return ks[int(np.argmin(np.diff(slope))) + 1]


def correlation_modules(correlations: DataFrame, epsilon: float = 2.0, k_min: int = 2, k_max: int = 150, linkage: str = "ward", junk: float = 0.05, span: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(modules (node, label, size, r2), curve (k, r2)) of correlations (f1, f2, cor): features are merged by
    1 - exp(-(epsilon (1 - |cor|))²), the tree is cut into k_min to k_max clusters, and the number taken is where the
    size-weighted median squared correlation stops rising steeply. Clusters whose own is below `junk`, and single features,
    are left out of the modules."""
    far = 1 - F.exp(-F.pow(epsilon * (1 - F.abs("cor")), F.lit(2.0)))
    merges = agglomerated(correlations.filter("f1 <> f2").select(F.col("f1").alias("a"), F.col("f2").alias("b"), far.alias("distance")), linkage)
    n = merges.count() + 1
    ks = list(range(min(k_min, n), min(k_max, n) + 1))
    labels = written(cut_trees(merges, ks))
    once = correlations.filter("f1 <> f2").select(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2"), "cor").distinct()
    quality = written(cut_quality(labels, once))
    curve = written(quality.groupBy("k").agg((F.sum(F.coalesce("r2", F.lit(0.0)) * F.col("size")) / F.sum("size")).alias("r2")))
    found = sorted((r["k"], r["r2"]) for r in curve.collect())  # a row a k
    best = turning_point([k for k, _ in found], [v for _, v in found], span)
    kept = quality.filter((F.col("k") == best) & (F.col("r2") >= junk))
    return labels.filter(F.col("k") == best).join(kept.drop("k"), "label").select("node", "label", "size", "r2"), curve
