"""Networks of samples from several kinds of data, and their fusion.

Distances and affinities are rows (a, b, distance) and (a, b, weight) of both orders, without the diagonal. The number of
samples (patients) is small beside the features; an affinity has samples squared rows, as its promise is a dense one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut


def sample_distances(continuous: DataFrame | None = None, categorical: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of samples: Euclidean over rows (sample, feature, value), the share of categories (sample, feature,
    value) that differ, or of both kinds Gower's mean of scaled differences and mismatches."""
    if categorical is None:
        of = lambda k: continuous.select(F.col("sample").alias(k), "feature", F.col("value").alias(f"v{k}"))
        return of("a").join(of("b"), "feature").filter("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum((F.col("va") - F.col("vb")) ** 2)).alias("distance"))
    of = lambda t, k: t.select(F.col("sample").alias(k), "feature", F.col("value").alias(f"v{k}"))
    cat = of(categorical, "a").join(of(categorical, "b"), "feature").filter("a <> b").select("a", "b", F.when(F.col("va").eqNullSafe(F.col("vb")), 0.0).otherwise(1.0).alias("d"))
    if continuous is None:
        return cat.groupBy("a", "b").agg(F.avg("d").alias("distance"))
    reach = continuous.groupBy("feature").agg(F.nullif(F.max("value") - F.min("value"), F.lit(0.0)).alias("reach"))
    num = of(continuous, "a").join(of(continuous, "b"), "feature").join(reach, "feature").filter("a <> b").select("a", "b", F.coalesce(F.abs(F.col("va") - F.col("vb")) / F.col("reach"), F.lit(0.0)).alias("d"))
    return num.unionByName(cat).groupBy("a", "b").agg(F.avg("d").alias("distance"))


def scaled_affinity(distances: DataFrame, k: int = 20, mu: float = 0.5) -> DataFrame:
    """(a, b, weight) = exp(-d^2 / (mu * e)), where e is the mean of d and of the mean distances of both ends to their k
    nearest samples."""
    near = distances.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.round("distance", 9), "b"))).filter(F.col("r") <= k)
    m = near.groupBy("a").agg(F.avg("distance").alias("m"))
    j = distances.join(m, "a").join(m.select(F.col("a").alias("b"), F.col("m").alias("n")), "b")
    e = (F.col("m") + F.col("n") + F.col("distance")) / 3
    return j.select("a", "b", F.coalesce(F.exp(-(F.col("distance") ** 2) / F.nullif(mu * e, F.lit(0.0))), F.lit(1.0)).alias("weight"))


def _full(w: DataFrame) -> DataFrame:
    """Rows sum to one, half of it on the diagonal."""
    total = w.groupBy("a").agg(F.sum("weight").alias("t"))
    off = w.join(total, "a").select("a", "b", F.coalesce(F.col("weight") / F.nullif(2 * F.col("t"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    return off.unionByName(total.select("a", F.col("a").alias("b"), F.lit(0.5).alias("weight")))


def _local(w: DataFrame, k: int) -> DataFrame:
    """Only the k largest of each row, summing to one."""
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("weight", 12)), "b"))
    near = w.withColumn("r", r).filter(F.col("r") <= k)
    total = near.groupBy("a").agg(F.sum("weight").alias("t"))
    return near.join(total, "a").select("a", "b", (F.col("weight") / F.nullif("t", F.lit(0.0))).alias("weight"))


def fused_network(affinities: list[DataFrame], k: int = 20, rounds: int = 20) -> DataFrame:
    """(a, b, weight) with a < b of two affinities or more: in each round every network becomes the mean of the others
    seen through its own nearest neighbours, S P S', symmetric and normalised anew; in the end they are averaged.

    S has k rows a sample, so a round makes k times samples squared rows, reduced on the map side."""
    if len(affinities) < 2:
        raise ValueError("fusion takes two affinities or more")
    local = [cut(_local(w, k)) for w in affinities]
    full = [cut(_full(w)) for w in affinities]
    for _ in range(rounds):
        new = []
        for i, s in enumerate(local):
            others = [p for j, p in enumerate(full) if j != i]
            mean = reduce(DataFrame.unionByName, others).groupBy("a", "b").agg((F.sum("weight") / len(others)).alias("p"))
            left = s.join(mean.withColumnRenamed("a", "u"), F.col("u") == s["b"]).select(s["a"].alias("x"), mean["b"].alias("v"), (F.col("weight") * F.col("p")).alias("q")).groupBy("x", "v").agg(F.sum("q").alias("q"))
            both = left.join(s.select(F.col("a").alias("y"), F.col("b").alias("v"), "weight"), "v").groupBy("x", "y").agg(F.sum(F.col("q") * F.col("weight")).alias("w"))
            even = both.select(F.col("x").alias("a"), F.col("y").alias("b"), "w").unionByName(both.select(F.col("y").alias("a"), F.col("x").alias("b"), "w"))
            new.append(cut(_full(even.filter("a <> b").groupBy("a", "b").agg((F.sum("w") / 2).alias("weight")))))
        full = new
    out = reduce(DataFrame.unionByName, full).filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return out.agg((F.sum("weight") / (2 * len(full))).alias("weight"))


def weighted_neighbours(first: DataFrame, second: DataFrame, knn_first: DataFrame, knn_second: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, weight, rank, share_first): neighbours of cells seen in two kinds of data (id, embedding), each with
    its neighbours (id, neighbour, distance).

    A cell's share of a kind follows from how much better its own neighbours there predict its vector than its
    neighbours in the other kind do, on the scale of its farthest neighbour; candidates of both kinds are then ranked
    by the weighted sum of their affinities."""

    def predicted(vectors: DataFrame, knn: DataFrame, name: str) -> DataFrame:
        x = vectors.select(F.col("id").alias("neighbour"), F.posexplode("embedding").alias("i", "x"))
        mean = knn.select("id", "neighbour").join(x, "neighbour").groupBy("id", "i").agg(F.avg("x").alias("p"))
        own = vectors.select("id", F.posexplode("embedding").alias("i", "x"))
        return own.join(mean, ["id", "i"]).groupBy("id").agg(F.sqrt(F.sum((F.col("x") - F.col("p")) ** 2)).alias(name))

    width = lambda knn, name: knn.groupBy("id").agg(F.nullif(F.max("distance"), F.lit(0.0)).alias(name))
    j = predicted(first, knn_first, "aa").join(predicted(first, knn_second, "ab"), "id").join(predicted(second, knn_second, "bb"), "id").join(predicted(second, knn_first, "ba"), "id")
    j = j.join(width(knn_first, "wa"), "id").join(width(knn_second, "wb"), "id")
    kernel = lambda d, w: F.coalesce(F.exp(-F.col(d) / F.col(w)), F.lit(1.0))
    lead_a, lead_b = kernel("aa", "wa") / (kernel("ab", "wa") + 1e-4), kernel("bb", "wb") / (kernel("ba", "wb") + 1e-4)
    share = j.select("id", (1 / (1 + F.exp(lead_b - lead_a))).alias("share_first"), "wa", "wb")
    near = knn_first.select("id", "neighbour").unionByName(knn_second.select("id", "neighbour")).distinct()

    def distance(vectors: DataFrame, name: str) -> DataFrame:
        a, b = vectors.select("id", F.col("embedding").alias("x")), vectors.select(F.col("id").alias("neighbour"), F.col("embedding").alias("y"))
        d = F.aggregate(F.zip_with("x", "y", lambda p, q: ((p - q) * (p - q)).cast("double")), F.lit(0.0), lambda t, v: t + v)
        return near.join(a, "id").join(b, "neighbour").select("id", "neighbour", F.sqrt(d).alias(name))

    pairs = distance(first, "da").join(distance(second, "db"), ["id", "neighbour"]).join(share, "id")
    weight = F.col("share_first") * kernel("da", "wa") + (1 - F.col("share_first")) * kernel("db", "wb")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "neighbour"))
    return pairs.withColumn("weight", weight).withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "neighbour", "weight", "rank", "share_first")
