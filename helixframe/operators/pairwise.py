"""Pairs: correlations, distances, overlaps of sets, reciprocal best hits, mutual information, topological overlap.

Matrices are long (sample, feature, value). Pairs are made by joining on the sample, and reduced on the map side to one
row per pair and task; what remains is features squared, never samples times features squared in one place. Covariance,
Pearson and cosine give every pair of features, also those that share no sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranks import average_rank
from helixframe.session import written


def completed(expr: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """The dense matrix of given samples and features, absent values as zero; for panels of few features."""
    every = samples.select("sample").distinct().join(features.select("feature").distinct())
    return every.join(expr, ["sample", "feature"], "left").select("sample", "feature", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


#: Features whose matrix of products a task holds whole: 32 MB.
GRAM = 2_048


def _gram(expr: DataFrame) -> DataFrame:
    """(f1, f2, sxy, s1): sums of products for f1 <= f2, and on the diagonal the sum of the feature, of few features. A sample
    is one row; a task adds up one matrix and gives what is not zero in it, so rows of the shuffle do not grow with the
    samples."""
    feature, sample = expr.schema["feature"].dataType.simpleString(), F.col("sample")
    rows = expr.select("sample", F.struct("feature", F.col("value").cast("double").alias("value")).alias("x")).groupBy(sample).agg(F.collect_list("x").alias("x")).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        g, s = np.zeros((64, 64)), np.zeros(64)
        for b in (batch.slice(k, 1_024) for batch in batches for k in range(0, batch.num_rows, 1_024)):
            lists = b.column("x")
            flat = lists.flatten()
            coded = flat.field("feature").dictionary_encode()
            at = np.array([place.setdefault(f, len(place)) for f in coded.dictionary.to_pylist()], np.int64)
            while len(place) > len(s):
                g, s = np.pad(g, (0, len(s))), np.pad(s, (0, len(s)))
            x = np.zeros((b.num_rows, len(s)))
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            np.add.at(x, (owner, at[coded.indices.to_numpy(zero_copy_only=False)]), flat.field("value").to_numpy(zero_copy_only=False))
            g += x.T @ x
            s += x.sum(0)
        if place:
            names = sorted(place)
            order = np.array([place[f] for f in names])
            g, s = g[np.ix_(order, order)], s[order]
            i, j = np.nonzero(np.triu(g != 0) | np.eye(len(names), dtype=bool))
            value = pa.array(names, coded.dictionary.type)
            yield pa.RecordBatch.from_arrays([value.take(pa.array(i)), value.take(pa.array(j)), pa.array(g[i, j]), pa.array(np.where(i == j, s[i], 0.0))], names=["f1", "f2", "sxy", "s1"])

    made = rows.mapInArrow(run, f"f1 {feature}, f2 {feature}, sxy double, s1 double")
    return made.groupBy("f1", "f2").agg(F.sum("sxy").alias("sxy"), F.sum("s1").alias("s1"))


def _cross(expr: DataFrame, n: int | None, features: int | None = None) -> DataFrame:
    """(f1, f2, sxy, s1, s2, q1, q2, n) for f1 < f2 with implicit zeros over n samples, or over those of `expr` if n is None:
    all pairs of features, sxy being 0 for those never seen together. Up to GRAM features are multiplied as matrices, more
    are joined on the sample. `features`, an upper bound of their number, and n save the two counts; for a count the matrix
    is written once, so that what makes it is not run again."""
    if n is None or features is None:
        expr = written(expr.select("sample", "feature", F.col("value").cast("double").alias("value")))
        n = expr.select("sample").distinct().count() if n is None else n
        features = expr.select("feature").distinct().count() if features is None else features
    if features <= GRAM:
        g = written(_gram(expr))  # features squared, read three times
        m, xy = g.filter("f1 = f2").select(F.col("f1").alias("feature"), F.col("s1").alias("s"), F.col("sxy").alias("q")), g.filter("f1 < f2").select("f1", "f2", "sxy")
    else:
        m = expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
        xy = _shared(expr, F.col("x") * F.col("y")).withColumnRenamed("part", "sxy")
    of = lambda k: m.select(F.col("feature").alias(f"f{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    every = of(1).join(of(2), F.col("f1") < F.col("f2"))  # as many rows as the result
    return every.join(xy, ["f1", "f2"], "left").withColumn("sxy", F.coalesce(F.col("sxy").cast("double"), F.lit(0.0))).withColumn("n", F.lit(float(n)))


def _shared(expr: DataFrame, part: Column) -> DataFrame:
    """(f1, f2, part): sums over the samples that two features share, of an expression of their values x and y."""
    a = expr.select("sample", F.col("feature").alias("f1"), F.col("value").alias("x"))
    b = expr.select("sample", F.col("feature").alias("f2"), F.col("value").alias("y"))
    return a.join(b, "sample").filter("f1 < f2").groupBy("f1", "f2").agg(F.sum(part).alias("part"))


def covariance(expr: DataFrame, n: int | None = None) -> DataFrame:
    """(f1, f2, cov) of the upper triangle."""
    return _cross(expr, n).select("f1", "f2", ((F.col("sxy") - F.col("s1") * F.col("s2") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def pearson(expr: DataFrame, n: int | None = None, features: int | None = None) -> DataFrame:
    """(f1, f2, cor) of the upper triangle; null for constant features."""
    top = F.col("sxy") - F.col("s1") * F.col("s2") / F.col("n")
    bottom = F.sqrt((F.col("q1") - F.col("s1") ** 2 / F.col("n")) * (F.col("q2") - F.col("s2") ** 2 / F.col("n")))
    return _cross(expr, n, features).select("f1", "f2", (top / F.nullif(bottom, F.lit(0.0))).alias("cor"))


def spearman(expr: DataFrame, n: int | None = None) -> DataFrame:
    """(f1, f2, cor): Pearson of ranks with shared ties, zeros implicit.

    The zeros of a feature are one block of ties. Ranks are taken less the rank of that block, which changes no correlation
    and makes the zeros zeros again, so only values that are not zero are ranked."""
    expr = written(expr.select("sample", "feature", F.col("value").cast("double").alias("value")))
    n = expr.select("sample").distinct().count() if n is None else n
    features = expr.select("feature").distinct().count()
    x, of = F.col("value"), Window.partitionBy("feature")
    some = expr.filter("value <> 0")
    ranked = some.withColumns({"rank": average_rank(["feature"], x), "zeros": F.lit(n) - F.count("*").over(of), "below": F.sum((x < 0).cast("long")).over(of)})
    level = F.col("below") + (F.col("zeros") + 1) / 2
    shifted = F.col("rank") + F.when(x > 0, F.col("zeros")).otherwise(0) - level
    # A feature of zeros alone stays, as a constant one.
    empty = expr.groupBy("feature").agg(F.max((x != 0).cast("int")).alias("any"), F.first("sample").alias("sample")).filter("any = 0")
    return pearson(ranked.select("sample", "feature", shifted.alias("value")).unionByName(empty.select("sample", "feature", F.lit(0.0).alias("value"))), n, features)


def cosine_distance(expr: DataFrame, n: int | None = None) -> DataFrame:
    """(f1, f2, distance) = 1 - |cosine|."""
    return _cross(expr, n).select("f1", "f2", (1 - F.abs(F.col("sxy") / F.sqrt(F.col("q1") * F.col("q2")))).alias("distance"))


def minkowski(expr: DataFrame, kind: str = "euclidean") -> DataFrame:
    """(f1, f2, distance): euclidean, manhattan or canberra, zeros implicit.

    What a feature adds beside zeros alone is one number; samples that two features share correct the sum of two of them.
    Euclidean distances of nearly equal features with large values lose digits by that."""
    if kind == "euclidean":
        return _cross(expr, 0).select("f1", "f2", F.sqrt(F.greatest(F.col("q1") + F.col("q2") - 2 * F.col("sxy"), F.lit(0.0))).alias("distance"))
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    alone, both = {
        "manhattan": (F.abs(v), F.abs(x - y) - F.abs(x) - F.abs(y)),
        "canberra": (F.lit(1.0), F.abs(x - y) / (F.abs(x) + F.abs(y)) - 2),
    }[kind]
    expr = written(expr.select("sample", "feature", v.cast("double").alias("value")))
    m = expr.groupBy("feature").agg(F.sum(F.when(v != 0, alone).otherwise(0.0)).alias("s"))
    of = lambda k: m.select(F.col("feature").alias(f"f{k}"), F.col("s").alias(f"s{k}"))
    return of(1).join(of(2), F.col("f1") < F.col("f2")).join(_shared(expr.filter("value <> 0"), both), ["f1", "f2"], "left").select("f1", "f2", (F.col("s1") + F.col("s2") + F.coalesce("part", F.lit(0.0))).alias("distance"))


def differential_correlation(a: DataFrame, n_a: int, b: DataFrame, n_b: int) -> DataFrame:
    """(f1, f2, cor_a, cor_b, z): difference of the Fisher transforms over its standard error; a feature without values in
    one half is constant there, so its cor and z are null."""
    both = pearson(a, n_a).withColumnRenamed("cor", "cor_a").join(pearson(b, n_b).withColumnRenamed("cor", "cor_b"), ["f1", "f2"], "full")
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-0.9999999)), F.lit(0.9999999)))
    z = (F.atanh(clip(F.col("cor_a"))) - F.atanh(clip(F.col("cor_b")))) / (1 / (n_a - 3) + 1 / (n_b - 3)) ** 0.5
    return both.select("f1", "f2", "cor_a", "cor_b", z.alias("z"))


def mirrored(pairs: DataFrame, value: str) -> DataFrame:
    """Both triangles of an upper triangle (f1, f2, value), without the diagonal."""
    return pairs.select("f1", "f2", value).unionByName(pairs.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), value))


def topological_overlap(pairs: DataFrame, value: str = "cor") -> DataFrame:
    """(f1, f2, tom) unsigned, from |value| of an upper triangle: (shared + a) / (min degree + 1 - a). What two features
    share is the square of the matrix: of up to GRAM features one product of blocks of rows a task, of more a join."""
    a = written(mirrored(pairs.select("f1", "f2", F.abs(value).alias("a")), "a"))  # read four times
    k = a.groupBy(F.col("f1").alias("f")).agg(F.sum("a").alias("k"))
    rows = a.filter("a > 0").select(F.col("f1").alias("sample"), F.col("f2").alias("feature"), F.col("a").alias("value"))
    small = k.count() <= GRAM
    shared = (_gram(rows).filter("f1 < f2") if small else _shared(rows, F.col("x") * F.col("y")).withColumnRenamed("part", "sxy")).select("f1", "f2", F.col("sxy").alias("l"))
    of = lambda i: k.select(F.col("f").alias(f"f{i}"), F.col("k").alias(f"k{i}"))
    j = a.filter("f1 < f2").join(shared, ["f1", "f2"], "left").join(of(1), "f1").join(of(2), "f2")
    return j.select("f1", "f2", ((F.coalesce("l", F.lit(0.0)) + F.col("a")) / (F.least("k1", "k2") + 1 - F.col("a"))).alias("tom"))


def set_similarity(left: DataFrame, right: DataFrame, overlap: bool = False) -> DataFrame:
    """(l, r, shared, similarity): Jaccard or overlap coefficient of (set_id, member) frames; only pairs with a shared
    member are made, others have similarity 0."""
    a, b = left.select(F.col("set_id").alias("l"), "member").distinct(), right.select(F.col("set_id").alias("r"), "member").distinct()
    na, nb = a.groupBy("l").agg(F.count("*").alias("nl")), b.groupBy("r").agg(F.count("*").alias("nr"))
    j = a.join(b, "member").groupBy("l", "r").agg(F.count("*").alias("shared")).join(na, "l").join(nb, "r")
    s = F.col("shared") / (F.least("nl", "nr") if overlap else F.col("nl") + F.col("nr") - F.col("shared"))
    return j.select("l", "r", "shared", s.alias("similarity"))


def reciprocal_best_hits(modules: DataFrame, min_similarity: float, k_best: int = 1, overlap: bool = False) -> DataFrame:
    """(origin_a, module_a, origin_b, module_b, similarity) of modules (origin, set_id, member): pairs among the k best
    of each other, between origins in order. Ties share a rank."""
    name = F.struct("origin", "set_id").alias("set_id")
    m = modules.select(name, "member")
    s = set_similarity(m, m, overlap).filter("l.origin < r.origin").filter(F.col("similarity") >= min_similarity).withColumn("s6", F.round("similarity", 9))
    r1 = F.rank().over(Window.partitionBy("l", "r.origin").orderBy(F.desc("s6")))
    r2 = F.rank().over(Window.partitionBy("r", "l.origin").orderBy(F.desc("s6")))
    best = s.withColumn("r1", r1).withColumn("r2", r2).filter((F.col("r1") <= k_best) & (F.col("r2") <= k_best))
    return best.select(F.col("l.origin").alias("origin_a"), F.col("l.set_id").alias("module_a"), F.col("r.origin").alias("origin_b"), F.col("r.set_id").alias("module_b"), "similarity")


def mutual_information(dense: DataFrame, bins: int) -> DataFrame:
    """(f1, f2, mi, nmi) in nats, of values cut into equal-width bins per feature; nmi is over the root of the entropies' product."""
    w = Window.partitionBy("feature")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    b = dense.withColumn("b", F.least(F.floor((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")).select("sample", "feature", F.coalesce("b", F.lit(0)).alias("b"))
    n = b.groupBy("feature").agg(F.count("*").alias("n"))
    h = b.groupBy("feature", "b").agg(F.count("*").alias("c")).join(n, "feature").withColumn("p", F.col("c") / F.col("n"))
    ent = h.groupBy("feature").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    x, y = b.select("sample", F.col("feature").alias("f1"), F.col("b").alias("b1")), b.select("sample", F.col("feature").alias("f2"), F.col("b").alias("b2"))
    joint = x.join(y, "sample").filter("f1 < f2").groupBy("f1", "f2", "b1", "b2").agg(F.count("*").alias("c"))
    joint = joint.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("f1", "f2"))).groupBy("f1", "f2").agg((-F.sum(F.col("p") * F.log("p"))).alias("h12"))
    of = lambda i: ent.select(F.col("feature").alias(f"f{i}"), F.col("h").alias(f"h{i}"))
    j = joint.join(of(1), "f1").join(of(2), "f2").withColumn("mi", F.col("h1") + F.col("h2") - F.col("h12"))
    return j.select("f1", "f2", "mi", (F.col("mi") / F.nullif(F.sqrt(F.col("h1") * F.col("h2")), F.lit(0.0))).alias("nmi"))


def pointwise_information(rows: DataFrame, n: int) -> DataFrame:
    """(f1, f2, pmi, npmi) of boolean features, as rows (sample, feature) where true, over n samples."""
    rows = rows.select("sample", "feature").distinct()
    c = rows.groupBy("feature").agg(F.count("*").alias("c"))
    a, b = rows.withColumnRenamed("feature", "f1"), rows.withColumnRenamed("feature", "f2")
    both = a.join(b, "sample").filter("f1 < f2").groupBy("f1", "f2").agg(F.count("*").alias("c12"))
    j = both.join(c.select(F.col("feature").alias("f1"), F.col("c").alias("c1")), "f1").join(c.select(F.col("feature").alias("f2"), F.col("c").alias("c2")), "f2")
    j = j.withColumn("pmi", F.log(F.col("c12") * F.lit(float(n)) / (F.col("c1") * F.col("c2"))))
    return j.select("f1", "f2", "pmi", F.coalesce(F.col("pmi") / F.nullif(-F.log(F.col("c12") / n), F.lit(0.0)), F.lit(1.0)).alias("npmi"))


def hamming(rows: DataFrame) -> DataFrame:
    """(f1, f2, distance): share of samples in which two categorical features differ; nulls differ from all but nulls."""
    a, b = (rows.select("sample", F.col("feature").alias(f"f{i}"), F.col("value").alias(f"v{i}")) for i in (1, 2))
    return a.join(b, "sample").filter("f1 < f2").groupBy("f1", "f2").agg(F.avg(F.when(F.col("v1").eqNullSafe(F.col("v2")), 0.0).otherwise(1.0)).alias("distance"))


def gower(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """(f1, f2, distance): mean over attributes of the scaled difference of numbers and the mismatch of categories; rows
    are (sample, feature, value), the sample being the attribute that two features are compared in."""
    w = Window.partitionBy("sample")
    scaled = numeric.withColumn("reach", F.max("value").over(w) - F.min("value").over(w))
    a, b = (scaled.select("sample", "reach", F.col("feature").alias(f"f{i}"), F.col("value").alias(f"v{i}")) for i in (1, 2))
    num = a.join(b.drop("reach"), "sample").filter("f1 < f2").select("f1", "f2", F.coalesce(F.abs(F.col("v1") - F.col("v2")) / F.nullif("reach", F.lit(0)), F.lit(0.0)).alias("d"))
    a, b = (categorical.select("sample", F.col("feature").alias(f"f{i}"), F.col("value").alias(f"v{i}")) for i in (1, 2))
    cat = a.join(b, "sample").filter("f1 < f2").select("f1", "f2", F.when(F.col("v1").eqNullSafe(F.col("v2")), 0.0).otherwise(1.0).alias("d"))
    return num.unionByName(cat).groupBy("f1", "f2").agg(F.avg("d").alias("distance"))


def radial(pairs: DataFrame, distance: str, epsilon: float, kind: str = "gaussian") -> DataFrame:
    """Adds affinity: a radial basis function of a distance; gaussian, bump or inverse_quadratic."""
    x = F.col(distance) * epsilon
    k = {"gaussian": F.exp(-x * x), "inverse_quadratic": 1 / (1 + x * x), "bump": F.when(x < 1, F.exp(-1 / (1 - x * x) + 1)).otherwise(0.0)}[kind]
    return pairs.withColumn("affinity", k)


def scale_free_fit(pairs: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """One row (r2, slope): log of the share of features per bin of connectivity against the log of its mean."""
    k = mirrored(pairs, value).groupBy("f1").agg(F.sum(value).alias("k"))
    lim = k.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"))
    at = F.coalesce(F.least(F.floor((F.col("k") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1)), F.lit(0))
    h = k.crossJoin(F.broadcast(lim)).groupBy(at.alias("b")).agg(F.avg("k").alias("mean"), (F.count("*") / F.first("n")).alias("p")).filter("mean > 0")
    return h.agg(F.regr_r2(F.log10("p"), F.log10("mean")).alias("r2"), F.regr_slope(F.log10("p"), F.log10("mean")).alias("slope"))


def pearson_between(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(f1, f2, cor) of every feature of `a` with every feature of `b` over n shared samples, zeros left out; null for
    constant features. For Spearman give ranks."""
    of = lambda t, k: t.groupBy(F.col("feature").alias(f"f{k}")).agg(F.sum("value").alias(f"s{k}"), F.sum(F.col("value") ** 2).alias(f"q{k}"))
    x, y = a.select("sample", F.col("feature").alias("f1"), F.col("value").alias("x")), b.select("sample", F.col("feature").alias("f2"), F.col("value").alias("y"))
    xy = x.join(y, "sample").groupBy("f1", "f2").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    every = of(a, 1).join(of(b, 2)).join(xy, ["f1", "f2"], "left")  # as many rows as the result
    top = F.coalesce("sxy", F.lit(0.0)) - F.col("s1") * F.col("s2") / n
    bottom = F.sqrt((F.col("q1") - F.col("s1") ** 2 / n) * (F.col("q2") - F.col("s2") ** 2 / n))
    return every.select("f1", "f2", (top / F.nullif(bottom, F.lit(0.0))).alias("cor"))


def pearson_of_pairs(expr: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(f1, f2, cor) of given pairs (f1, f2) only, over n samples with zeros left out: values meet by feature and sample,
    so nothing but the pairs asked for is made."""
    pairs = pairs.select("f1", "f2").distinct()
    m = expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    x = pairs.join(expr.select(F.col("feature").alias("f1"), "sample", F.col("value").alias("x")), "f1")
    xy = x.join(expr.select(F.col("feature").alias("f2"), "sample", F.col("value").alias("y")), ["f2", "sample"]).groupBy("f1", "f2").agg(F.sum(F.col("x") * F.col("y")).alias("sxy"))
    of = lambda k: m.select(F.col("feature").alias(f"f{k}"), F.col("s").alias(f"s{k}"), F.col("q").alias(f"q{k}"))
    j = pairs.join(of(1), "f1").join(of(2), "f2").join(xy, ["f1", "f2"], "left")
    top = F.coalesce("sxy", F.lit(0.0)) - F.col("s1") * F.col("s2") / n
    bottom = F.sqrt((F.col("q1") - F.col("s1") ** 2 / n) * (F.col("q2") - F.col("s2") ** 2 / n))
    return j.select("f1", "f2", (top / F.nullif(bottom, F.lit(0.0))).alias("cor"))


def variances(expr: DataFrame, n: int) -> DataFrame:
    """(feature, var) over n samples, zeros left out."""
    return expr.groupBy("feature").agg(((F.sum(F.col("value") ** 2) - F.sum("value") ** 2 / n) / (n - 1)).alias("var"))


def correlation_of_covariance(cov: DataFrame, var: DataFrame) -> DataFrame:
    """(f1, f2, cor) of covariances (f1, f2, cov) and variances (feature, var); null where a variance is 0."""
    of = lambda k: var.select(F.col("feature").alias(f"f{k}"), F.col("var").alias(f"v{k}"))
    return cov.join(of(1), "f1").join(of(2), "f2").select("f1", "f2", (F.col("cov") / F.nullif(F.sqrt(F.col("v1") * F.col("v2")), F.lit(0.0))).alias("cor"))


def upper_triangle(pairs: DataFrame, value: str, diagonal: float | None = None, least: float | None = None) -> DataFrame:
    """(f1, f2, value) with f1 < f2 of a symmetric table in any order, or f1 <= f2 where the `diagonal` has a value; only
    absolute values of `least` and more if that is given."""
    one = pairs.filter("f1 <> f2").groupBy(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2")).agg(F.max(value).alias(value))
    if diagonal is not None:
        names = pairs.select(F.explode(F.array("f1", "f2")).alias("f1")).distinct()
        one = one.unionByName(names.select("f1", F.col("f1").alias("f2"), F.lit(float(diagonal)).alias(value)))
    return one if least is None else one.filter(F.abs(value) >= least)


def row_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, similarity) of the sets of integers (id, items) of two tables, row by row; two empty sets are equal."""
    j = a.select("id", F.array_distinct("items").alias("x")).join(b.select("id", F.array_distinct("items").alias("y")), "id")
    both = F.size(F.array_intersect("x", "y"))
    return j.select("id", F.coalesce(both / F.nullif(F.size("x") + F.size("y") - both, F.lit(0)), F.lit(1.0)).alias("similarity"))


def connectivity_by_epsilon(pairs: DataFrame, distance: str, epsilons: list[float], kind: str = "gaussian") -> DataFrame:
    """(epsilon, feature, k): sum of affinities of each feature for each epsilon, from an upper triangle of distances."""
    grid = pairs.select("f1", "f2", distance, F.explode(F.array(*map(F.lit, map(float, epsilons)))).alias("epsilon"))
    x = F.col(distance) * F.col("epsilon")
    k = {"gaussian": F.exp(-x * x), "inverse_quadratic": 1 / (1 + x * x), "bump": F.when(x < 1, F.exp(-1 / (1 - x * x) + 1)).otherwise(0.0)}[kind]
    a = grid.select("epsilon", F.explode(F.array("f1", "f2")).alias("feature"), k.alias("a"))
    return a.groupBy("epsilon", "feature").agg(F.sum("a").alias("k"))


def critical_value(values: DataFrame, value: str, key: list[str], alpha: float = 0.05, draws: int = 100_000, seed: int = 42) -> DataFrame:
    """One row (critical): the 1 - alpha quantile of at most `draws` values drawn by a seeded hash of their key."""
    order = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key), F.lit(str(seed))))
    return values.orderBy(order, *key).limit(draws).agg(F.percentile(value, F.lit(1 - alpha)).alias("critical"))


def above_critical(pairs: DataFrame, value: str, key: list[str], alpha: float = 0.05, draws: int = 100_000, seed: int = 42) -> DataFrame:
    """Rows whose value reaches the critical one."""
    return pairs.crossJoin(F.broadcast(critical_value(pairs, value, key, alpha, draws, seed))).filter(F.col(value) >= F.col("critical"))


def correlated_best_hits(modules: DataFrame, min_similarity: float, k_best: int = 1) -> DataFrame:
    """(origin_a, module_a, origin_b, module_b, similarity): reciprocal best hits of modules given as loadings (origin,
    set_id, feature, value), by the absolute correlation over the features that both origins have."""
    name = F.struct("origin", "set_id")
    m = modules.select("origin", "feature", name.alias("m"), "value")
    a, b = (m.select(F.col("origin").alias(f"o{x}"), "feature", F.col("m").alias(f"m{x}"), F.col("value").alias(f"v{x}")) for x in "ab")
    both = a.join(b, "feature").filter("oa < ob")
    s = both.groupBy("ma", "mb").agg(F.abs(F.corr("va", "vb")).alias("similarity")).filter(F.col("similarity") >= min_similarity).withColumn("s6", F.round("similarity", 9))
    r1 = F.rank().over(Window.partitionBy("ma", "mb.origin").orderBy(F.desc("s6")))
    r2 = F.rank().over(Window.partitionBy("mb", "ma.origin").orderBy(F.desc("s6")))
    best = s.withColumn("r1", r1).withColumn("r2", r2).filter((F.col("r1") <= k_best) & (F.col("r2") <= k_best))
    return best.select(F.col("ma.origin").alias("origin_a"), F.col("ma.set_id").alias("module_a"), F.col("mb.origin").alias("origin_b"), F.col("mb.set_id").alias("module_b"), "similarity")


def split_by_sign(pairs: DataFrame, modules: DataFrame, value: str = "cor") -> DataFrame:
    """(module, feature, sign, mean_cor): members of modules (module, feature) split by the sign of their correlation with
    the member that correlates most, in absolute terms, with all others."""
    m = mirrored(pairs, value)
    of = lambda k: modules.select(F.col("feature").alias(f"f{k}"), F.col("module").alias(f"m{k}"))
    own = m.join(of(1), "f1").join(of(2), "f2").filter("m1 = m2").select(F.col("m1").alias("module"), "f1", "f2", value)
    hub = own.groupBy("module", "f1").agg(F.avg(F.abs(value)).alias("a")).withColumn("r", F.row_number().over(Window.partitionBy("module").orderBy(F.desc(F.round("a", 9)), "f1"))).filter("r = 1").select("module", F.col("f1").alias("hub"))
    with_hub = own.join(hub, "module").filter("f2 = hub").select("module", F.col("f1").alias("feature"), F.col(value).alias("c")).unionByName(hub.select("module", F.col("hub").alias("feature"), F.lit(1.0).alias("c")))
    mean = own.groupBy("module", F.col("f1").alias("feature")).agg(F.avg(value).alias("mean_cor"))
    return with_hub.join(mean, ["module", "feature"], "left").select("module", "feature", F.when(F.col("c") < 0, -1).otherwise(1).alias("sign"), "mean_cor")


def module_quality(pairs: DataFrame, modules: DataFrame, value: str = "cor") -> DataFrame:
    """(module, size, r2_median, r2_mad): squared correlations among the members of each module (module, feature)."""
    of = lambda k: modules.select(F.col("feature").alias(f"f{k}"), F.col("module").alias(f"m{k}"))
    own = pairs.join(of(1), "f1").join(of(2), "f2").filter("m1 = m2").select(F.col("m1").alias("module"), (F.col(value) ** 2).alias("r2"))
    mid = own.groupBy("module").agg(F.percentile("r2", F.lit(0.5)).alias("r2_median"))
    mad = own.join(mid, "module").groupBy("module", "r2_median").agg((1.4826 * F.percentile(F.abs(F.col("r2") - F.col("r2_median")), F.lit(0.5))).alias("r2_mad"))
    return modules.groupBy("module").agg(F.count("*").alias("size")).join(mad, "module")


def cluster_stability(runs: DataFrame) -> DataFrame:
    """(feature, mean_jaccard, sd_jaccard): how alike a feature's cluster stays over runs (run, feature, cluster): Jaccard
    overlap of its clusters in each pair of runs, from counts of members that clusters of two runs share."""
    size = runs.groupBy("run", "cluster").agg(F.count("*").alias("n"))
    a, b = (runs.select("feature", F.col("run").alias(f"r{x}"), F.col("cluster").alias(f"c{x}")) for x in "ab")
    both = a.join(b, "feature").filter("ra < rb").groupBy("ra", "ca", "rb", "cb").agg(F.count("*").alias("shared"), F.collect_list("feature").alias("features"))
    of = lambda x: size.select(F.col("run").alias(f"r{x}"), F.col("cluster").alias(f"c{x}"), F.col("n").alias(f"n{x}"))
    j = both.join(of("a"), ["ra", "ca"]).join(of("b"), ["rb", "cb"]).withColumn("j", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return j.select(F.explode("features").alias("feature"), "j").groupBy("feature").agg(F.avg("j").alias("mean_jaccard"), F.coalesce(F.stddev_samp("j"), F.lit(0.0)).alias("sd_jaccard"))
