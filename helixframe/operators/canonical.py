"""Integration of batches by canonical correlation: shared components of two tables, anchors between them, and corrections.

Tables are (id, embedding), the embedding being a row's values of the chosen genes. The matrix of products of all rows of one
table with all rows of the other is never made: a pass over a table gives one matrix of genes times components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.factors import mapped, summed
from helixframe.operators.graphs import WIDE, approximate_neighbours, nearest_neighbours
from helixframe.session import sweep, tables, written

#: Rows up to which neighbours are searched exactly: those of one block of the exact search.
EXACT_ROWS = WIDE


def standardised(vectors: DataFrame) -> DataFrame:
    """Each row less its mean, over its standard deviation; constant rows become zeros. Rows without an embedding go."""

    def scale(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(1, keepdims=True)
        sd = x.std(1, ddof=1, keepdims=True) if x.shape[1] > 1 else np.zeros((len(x), 1))
        return np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)

    return mapped(vectors.filter("embedding is not null"), scale, "embedding")


def _root(gram: np.ndarray) -> np.ndarray:
    """What makes columns with this matrix of inner products orthonormal; directions within rounding of zero are dropped."""
    values, basis = np.linalg.eigh((gram + gram.T) / 2)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-13
    return basis[:, good] / np.sqrt(values[good])


def canonical_vectors(a: DataFrame, b: DataFrame, k: int, oversample: int = 10, power: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """((id, u) of a, (id, u) of b, values, loadings): leading singular vectors of the products of rows of a with rows of b,
    by a randomised range finder with `power` iterations, and the genes' loadings (genes times components).

    An iteration is one pass over each table. The tall bases are never written: they are a table times a matrix of genes
    times components, and their inner products come from the same pass, so all that meets on the driver is of that size.
    Components that are null within rounding are left out. Of each component, the largest loading is positive."""
    first = a.filter("embedding is not null").select(F.size("embedding").alias("g")).first()
    genes = first["g"] if first else 0
    if not genes:
        empty = lambda t: t.select("id", F.array().cast("array<double>").alias("u"))
        return empty(a), empty(b), np.zeros(0), np.zeros((0, 0))
    spread = lambda t, m: summed(t, lambda x: x.T @ (x @ m), m.shape)
    width = min(k + oversample, genes)
    m = spread(b, np.random.default_rng(seed).normal(size=(genes, width)))
    for turn in range(power + 1):
        m = m / max(np.abs(m).max(), 1e-300)
        over = spread(a, m)
        left = m @ (root := _root(m.T @ over))  # a times left is orthonormal
        n = over @ root
        under = spread(b, n)
        inner = n.T @ under
        if turn < power:
            m = under @ _root(inner)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(values)[::-1][:k]
    best = best[values[best] > max(values.max(initial=0.0), 0.0) * 1e-12]
    s = np.sqrt(values[best])
    left, right = left @ turned[:, best], n @ turned[:, best] / s
    loadings = over @ root @ turned[:, best] + under @ turned[:, best] / s
    sign = np.where(loadings[np.abs(loadings).argmax(0), np.arange(len(s))] < 0, -1.0, 1.0) if len(s) else np.ones(0)
    left, right = left * sign, right * sign
    return mapped(a, lambda x: x @ left, "u"), mapped(b, lambda x: x @ right, "u"), s, loadings * sign


def top_genes(loadings: np.ndarray, most: int) -> np.ndarray:
    """The genes with the largest loadings of either sign, as many of each component as give at most `most` in all."""
    order = np.argsort(-np.abs(loadings), axis=0, kind="stable")
    chosen: np.ndarray = np.zeros(0, np.int64)
    for each in range(1, len(loadings) + 1):
        now = np.unique(order[:each])
        if len(now) > most:
            break
        chosen = now
    return chosen if len(chosen) else np.unique(order[:1])[:most]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _near(of: DataFrame, k: int, asked: DataFrame) -> DataFrame:
    """The k nearest rows of a table for each row asked: exactly, or with measured recall in large tables."""
    search = nearest_neighbours if of.count() <= EXACT_ROWS else approximate_neighbours
    return search(of, k, asked).select("id", "neighbour", "distance")


def canonical_anchors(a: DataFrame, b: DataFrame, dims: int = 30, k_anchor: int = 5, k_filter: int = 200, k_score: int = 30, top: int = 200, seed: int = 42) -> DataFrame:
    """(a, b, score): rows of two tables that are among the `k_anchor` nearest of each other in the shared components, of
    unit length, and of which b is also among the `k_filter` nearest of a by the genes with the largest loadings (0: no such
    filter). The score is the number of the `k_score` nearest in either table that both have, scaled from the 1 % quantile
    to the 90 % quantile, within 0 and 1. Ids are unique over both tables."""
    a, b = written(standardised(a)), written(standardised(b))
    ua, ub, _, loadings = canonical_vectors(a, b, dims, seed=seed)
    if not loadings.size:
        return a.join(b.select("id"), "id").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("score")).limit(0)
    place = lambda t: written(mapped(t.withColumnRenamed("u", "embedding"), _unit, "embedding"))
    ua, ub = place(ua), place(ub)
    k = max(k_anchor, k_score)
    ranked = lambda t: written(t.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "neighbour"))))
    aa, ab, ba, bb = (ranked(_near(of, k, asked)) for of, asked in ((ua, ua), (ub, ua), (ua, ub), (ub, ub)))
    first = lambda t: t.filter(F.col("rank") <= k_anchor)
    pairs = first(ab).select(F.col("id").alias("a"), F.col("neighbour").alias("b")).join(first(ba).select(F.col("neighbour").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_semi")
    if k_filter:
        genes = top_genes(loadings, top)
        of = lambda t: written(mapped(t, lambda x: _unit(x[:, genes]), "embedding"))
        asked = of(a).join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        pairs = pairs.join(_near(of(b), k_filter, asked).select(F.col("id").alias("a"), F.col("neighbour").alias("b")), ["a", "b"], "left_semi")
    pairs = written(pairs)
    around = lambda *t: t[0].unionByName(t[1]).filter(F.col("rank") <= k_score)
    of_a = pairs.join(around(aa, ab).select(F.col("id").alias("a"), "neighbour"), "a")
    common = of_a.join(around(ba, bb).select(F.col("id").alias("b"), "neighbour"), ["b", "neighbour"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    counted = written(pairs.join(common, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).cast("double").alias("common")))
    cut = counted.agg(F.percentile("common", F.lit(0.01)).alias("low"), F.percentile("common", F.lit(0.9)).alias("high")).first()
    low, high = cut["low"] or 0.0, cut["high"] or 0.0
    score = F.least(F.greatest((F.col("common") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) if high > low else F.lit(1.0)
    return counted.select("a", "b", score.alias("score"))


def corrected(query: DataFrame, reference: DataFrame, anchors: DataFrame, k_weight: int = 100, sd: float = 1.0) -> DataFrame:
    """(id, embedding): `query` moved onto `reference` along anchors (a of the query, b of the reference, score). A row takes
    the mean offset of the `k_weight` nearest rows that have anchors, itself included, with weights 1 - exp(-d / (2 / sd)²),
    d being the score times 1 - distance / that to the farthest of them. Without anchors of any weight a row stays."""
    q = query.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    dims = q.select(F.max(F.size("embedding")).alias("d")).first()["d"] or 0
    r = reference.select(F.col("id").alias("b"), F.col("embedding").cast("array<double>").alias("to"))
    moves = anchors.join(q.select(F.col("id").alias("a"), F.col("embedding").alias("from")), "a").join(r, "b")
    # What an anchored row adds to any sum depends on its distance only through the weight, so offsets are kept by anchor.
    moves = written(moves.select("a", "score", F.zip_with("to", "from", lambda x, y: x - y).alias("by")))
    held = written(q.join(moves.select(F.col("a").alias("id")).distinct(), "id", "left_semi"))
    if not held.head(1):
        return q
    near = _near(held, k_weight, q).unionByName(held.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")))
    of = Window.partitionBy("id")
    near = near.withColumn("rank", F.row_number().over(of.orderBy(F.round("distance", 9), "neighbour"))).filter(F.col("rank") <= k_weight)
    near = near.withColumn("far", F.max("distance").over(of)).withColumn("close", F.coalesce(1 - F.col("distance") / F.nullif(F.col("far"), F.lit(0.0)), F.lit(1.0)))
    w = 1 - F.exp(-F.col("close") * F.col("score") / (2 / sd) ** 2)
    j = near.select("id", F.col("neighbour").alias("a"), "close").join(moves, "a").withColumn("w", w)
    total = j.groupBy("id").agg(F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col("by")[i]).alias(f"d{i}") for i in range(dims))).filter("w > 0")
    step = total.select("id", F.array(*(F.col(f"d{i}") / F.col("w") for i in range(dims))).alias("by"))
    return q.join(step, "id", "left").select("id", F.when(F.col("by").isNull(), F.col("embedding")).otherwise(F.zip_with("embedding", "by", lambda x, y: x + y)).alias("embedding"))


def integrated(vectors: DataFrame, embedding: DataFrame, batches: DataFrame, k_weight: int = 100, sd: float = 1.0, **more) -> DataFrame:
    """(id, embedding): an embedding common to all batches, for instance components of all rows, corrected batch by batch.
    `vectors` (id, embedding) holds genes, `batches` (id, batch) few batches. Anchors are found for each pair of batches; the
    two groups with the most anchors for the rows of the smaller one are merged, the smaller onto the larger, until one
    group is left. `more` goes to canonical_anchors(). Rows without a batch stay as they are."""
    before = tables()
    own = written(vectors.filter("embedding is not null").join(batches.dropna(), "id").select("id", "embedding", "batch"))
    at = written(embedding.select("id", F.col("embedding").cast("array<double>").alias("embedding")))
    sizes = {r["batch"]: r["n"] for r in own.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
    of = lambda x: own.filter(F.col("batch") == x).select("id", "embedding")
    found = {(x, y): written(canonical_anchors(of(x), of(y), **more)) for x, y in combinations(sorted(sizes), 2)}
    counts = {pair: t.count() for pair, t in found.items()}
    sweep(vectors.sparkSession, before, own, at, *found.values())
    groups = [frozenset([x]) for x in sorted(sizes)]
    size = lambda g: sum(sizes[x] for x in g)
    between = lambda g, h: [(x, y) for x in g for y in h]
    share = lambda g, h: sum(counts.get(p, counts.get(p[::-1], 0)) for p in between(g, h)) / min(size(g), size(h))
    member = batches.dropna().select("id", "batch")
    while len(groups) > 1:
        g, h = max(combinations(groups, 2), key=lambda p: (share(*p), -groups.index(p[0]), -groups.index(p[1])))
        query, reference = (g, h) if size(g) < size(h) else (h, g)
        pairs = None
        for x, y in sorted(between(query, reference)):
            t = found[x, y] if (x, y) in found else found[y, x].select(F.col("b").alias("a"), F.col("a").alias("b"), "score")
            pairs = t if pairs is None else pairs.unionByName(t)
        rows = lambda group: at.join(member.filter(F.col("batch").isin(*group)).select("id"), "id", "left_semi")  # noqa: E731, B023
        moved = corrected(rows(query), rows(reference), pairs, k_weight, sd)
        at = written(at.join(moved.select("id"), "id", "left_anti").unionByName(moved))
        groups = [x for x in groups if x not in (g, h)] + [g | h]
        sweep(vectors.sparkSession, before, own, at, *found.values())
    sweep(vectors.sparkSession, before, at)
    return at
