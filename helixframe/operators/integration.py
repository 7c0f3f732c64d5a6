"""Cells across samples: simulated doublets, batches matched by mutual neighbours, labels handed over, merged counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graphs import nearest_neighbours


def simulated_doublets(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell, gene, raw) of doublets (cell, first, second): the counts of both parents, added. A cell paired with itself
    counts twice; a parent without counts adds nothing."""
    parents = pairs.select("cell", F.explode(F.array("first", "second")).alias("parent"))
    own = counts.select(F.col("cell").alias("parent"), "gene", "raw")
    return parents.join(own, "parent").groupBy("cell", "gene").agg(F.sum("raw").alias("raw"))


def doublet_scores(knn: DataFrame, simulated: DataFrame, rate: float, ratio: float) -> DataFrame:
    """(id, n_simulated, score) of real cells: the probability of being a doublet from the share of simulated ones (ids)
    among the neighbours (id, neighbour), with an expected `rate` of doublets and `ratio` simulated cells for each real."""
    flag = simulated.select(F.col("id").alias("neighbour")).distinct().withColumn("sim", F.lit(1))
    c = knn.join(simulated.select("id"), "id", "left_anti").join(flag, "neighbour", "left").groupBy("id").agg(F.count("sim").alias("n_simulated"), F.count("*").alias("k"))
    q = (F.col("n_simulated") + 1) / (F.col("k") + 2)
    return c.select("id", "n_simulated", (q * rate / ratio / (1 - rate - q * (1 - rate - rate / ratio))).alias("score"))


def mutual_neighbours(vectors: DataFrame, other: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): pairs of a row of `vectors` and a row of `other`, each among the k nearest of the other one.
    Ids are unique over both tables."""
    there = nearest_neighbours(other, k, vectors, blocks).select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "distance")
    back = nearest_neighbours(vectors, k, other, blocks).select(F.col("neighbour").alias("a"), F.col("id").alias("b"))
    return there.join(back, ["a", "b"], "left_semi")


def matched_batch(vectors: DataFrame, reference: DataFrame, k: int, smooth: int = 10, blocks: int | None = None) -> DataFrame:
    """(id, embedding): a batch moved onto a reference. Each row takes the mean of the offsets of its `smooth` nearest
    anchors, rows with mutual neighbours in the reference, with Gaussian weights whose width is the distance to the
    farthest of them. Without any anchor the batch stays as it is."""
    pairs = mutual_neighbours(vectors, reference, k, blocks)
    v = vectors.select("id", F.posexplode("embedding").alias("i", "x"))
    r = reference.select(F.col("id").alias("b"), F.posexplode("embedding").alias("i", "y"))
    shift = pairs.select("a", "b").join(r, "b").groupBy("a", "i").agg(F.avg("y").alias("y")).join(v.withColumnRenamed("id", "a"), ["a", "i"]).select("a", "i", (F.col("y") - F.col("x")).alias("d"))
    anchors = vectors.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    near = nearest_neighbours(anchors, smooth, vectors, blocks).select("id", F.col("neighbour").alias("a"), "distance")
    near = near.unionByName(anchors.select("id", F.col("id").alias("a"), F.lit(0.0).alias("distance")))  # an anchor is its own nearest
    width = F.nullif(F.max("distance").over(Window.partitionBy("id")), F.lit(0.0))
    near = near.withColumn("w", F.coalesce(F.exp(-((F.col("distance") / width) ** 2)), F.lit(1.0)))
    moved = near.join(shift, "a").groupBy("id", "i").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("d"))
    cells = v.join(moved, ["id", "i"], "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("x") + F.coalesce("d", F.lit(0.0))).alias("x")))).alias("s"))
    return cells.select("id", F.col("s.x").alias("embedding"))


def transferred_labels(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, share): the label (id, label) most frequent among a row's neighbours, ties to the smaller one, and its
    share. Neighbours without a label have no say; a row without any labelled neighbour has no row."""
    known = labels.dropna().select(F.col("id").alias("neighbour"), "label")
    c = knn.join(known, "neighbour").groupBy("id", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id")
    return c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "label"))).filter("r = 1").select("id", "label", "share")


def meta_cells(counts: DataFrame, knn: DataFrame, centres: DataFrame) -> DataFrame:
    """(meta, gene, raw): counts added up over the neighbourhoods of centre cells (id), centres included."""
    own = centres.select("id").distinct()
    held = knn.join(own, "id", "left_semi").select(F.col("id").alias("meta"), F.col("neighbour").alias("cell")).unionByName(own.select(F.col("id").alias("meta"), F.col("id").alias("cell"))).distinct()
    return held.join(counts.select("cell", "gene", "raw"), "cell").groupBy("meta", "gene").agg(F.sum("raw").alias("raw"))


def background_scaled(counts: DataFrame, empty: DataFrame, n_empty: int, pseudocount: float = 10.0) -> DataFrame:
    """(cell, gene, value, at_zero): log counts of proteins against those of `n_empty` empty droplets (cell, gene, raw) in
    their standard deviations. Zeros are no rows: in droplets they enter as closed forms, and `at_zero` is the value of
    the cells that have none. Proteins that do not vary in empty droplets are only centred."""
    x, zero = F.log(F.col("raw") + pseudocount), math.log(pseudocount)
    s = empty.groupBy("gene").agg(F.sum(x - zero).alias("s"), F.sum((x - zero) ** 2).alias("q"))
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") ** 2 / n_empty) / max(n_empty - 1, 1)))
    b = s.select("gene", (F.col("s") / n_empty).alias("mean"), F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0)).alias("spread"))
    mean, sd = F.coalesce("mean", F.lit(0.0)), F.coalesce("spread", F.lit(1.0))
    return counts.join(b, "gene", "left").select("cell", "gene", ((x - zero - mean) / sd).alias("value"), (-mean / sd).alias("at_zero"))


def local_correlation(values: DataFrame, edges: DataFrame, genes: DataFrame) -> DataFrame:
    """(g1, g2, cor) for g1 <= g2 among chosen `genes`: the sum over edges of z-scored values of the one gene at an end and
    of the other gene at the other end, both ways, halved. Values (cell, gene, value) have zeros as rows. Pairs of genes
    are made from sums per cell, so `genes` is the short list that local autocorrelation picks."""
    w = Window.partitionBy("gene")
    z = values.join(genes.select("gene").distinct(), "gene").select("cell", "gene", ((F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))).alias("z")).filter("z is not null")
    way = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    around = way.join(z, F.col("dst") == F.col("cell")).groupBy(F.col("src").alias("cell"), F.col("gene").alias("g2")).agg(F.sum(F.col("weight") * F.col("z")).alias("y"))
    return z.withColumnRenamed("gene", "g1").join(around, "cell").filter("g1 <= g2").groupBy("g1", "g2").agg((F.sum(F.col("z") * F.col("y")) / 2).alias("cor"))

