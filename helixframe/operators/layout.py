"""Layouts of neighbour graphs in a few dimensions by attraction along edges and repulsion from drawn rows (UMAP)."""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.trajectory import leading_vectors
from helixframe.session import sweep, tables, written

#: Rows of a block, about: what one task moves at a time.
BLOCK_ROWS = 20_000
#: Rows from which a block draws those that repel, of all blocks together and anew in each round.
DRAWN = 4_096
#: Halvings in the search for a row's width.
HALVINGS = 64


def _width(distances: Column, nearest: Column, target: float) -> Column:
    """The width at which the sum of exp(-(distance - nearest) / width) is `target`, found by halving in column expressions."""

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        total = F.aggregate(distances, F.lit(0.0), lambda t, d: t + F.exp(-F.greatest(d - nearest, F.lit(0.0)) / at))
        wide = total > target
        up = F.when(s["high"] < 0, at * 2).otherwise((at + s["high"]) / 2)
        return F.struct(F.when(wide, s["low"]).otherwise(at).alias("low"), F.when(wide, at).otherwise(s["high"]).alias("high"), F.when(wide, (s["low"] + at) / 2).otherwise(up).alias("at"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(-1.0).alias("high"), F.lit(1.0).alias("at"))  # a high below zero: none yet
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step)["at"]


def fuzzy_graph(knn: DataFrame) -> DataFrame:
    """(src, dst, weight), both directions, from neighbours (id, neighbour, distance): exp(-(distance - nearest) / width),
    where `nearest` is the smallest distance above zero and the width makes a row's weights add up to log2 of the number of
    its neighbours, itself included; a and b of the two directions join to a + b - ab. A row's neighbours are one array.

    Widths are at least a thousandth of the row's mean distance. A row of equal distances has weights of one."""
    rows = knn.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("distance").cast("double").alias("distance"), "neighbour"))).alias("n"))
    d = F.col("n.distance")
    rows = rows.withColumn("nearest", F.coalesce(F.array_min(F.filter(d, lambda x: x > 0)), F.lit(0.0))).withColumn("mean", F.aggregate(d, F.lit(0.0), lambda t, x: t + x) / F.size(d))
    # The row itself counts towards the logarithm but adds no weight, as in the published method.
    rows = rows.withColumn("width", F.greatest(_width(d, F.col("nearest"), F.log2(F.size(d) + F.lit(1.0))), F.col("mean") * 1e-3, F.lit(1e-12)))
    one = rows.select(F.col("id").alias("src"), F.explode("n").alias("e"), "nearest", "width")
    w = one.select("src", F.col("e.neighbour").alias("dst"), F.exp(-F.greatest(F.col("e.distance") - F.col("nearest"), F.lit(0.0)) / F.col("width")).alias("w"))
    both = w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("weight"))


def curve(spread: float = 1.0, min_dist: float = 0.1) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), fitted to a plateau up to min_dist and an exponential of `spread` beyond, by Gauss and
    Newton with damping."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([1.0, 1.0]), 1e-2
    f = lambda p: 1 / (1 + p[0] * x ** (2 * p[1]))
    for _ in range(200):
        g, power = f(p), x ** (2 * p[1])
        j = np.stack([-(g**2) * power, -(g**2) * p[0] * power * 2 * np.log(x)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (y - g))
        new = p + step
        if new.min() > 0 and ((y - f(new)) ** 2).sum() <= ((y - g) ** 2).sum():
            p, damp = new, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 4
    return float(p[0]), float(p[1])


def spectral_start(graph: DataFrame, dims: int, size: float = 10.0, **more) -> DataFrame:
    """(id, at array): the leading eigenvectors of the normalised graph without the first, the largest entry at `size`, with
    a hundred-thousandth of it as hashed noise, so that rows that fall together part."""
    degree = written(graph.groupBy("src").agg(F.sum("weight").alias("d")))
    a = graph.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
    found, values, _ = leading_vectors(a, dims + 1, **more)
    most = found.select(*(F.max(F.abs(F.col("v")[j])).alias(f"m{j}") for j in range(1, len(values)))).first() if len(values) > 1 else {}
    noise = lambda j: (F.pmod(F.xxhash64("id", F.lit(j)), F.lit(2_000_003)) / 1_000_001.5 - 1) * (size * 1e-5)
    entry = lambda j: F.col("v")[j] * (size / (most[f"m{j}"] or 1.0)) if j < len(values) else F.lit(0.0)
    return found.select("id", F.array(*(entry(j + 1) + noise(j) for j in range(dims))).alias("at"))


def _moved(pdf: pd.DataFrame, drawn: np.ndarray, names: np.ndarray, of: tuple[float, float], rates: np.ndarray, negatives: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of a block after one pass over its edges for each of `rates`. Rows of the block meet at their newest
    positions, rows of others where they stood at the start of the round."""
    own = pdf[pdf["dst"].isna()].sort_values("src")
    edges = pdf[pdf["dst"].notna()].sort_values(["src", "dst"])
    ids, y = own["src"].to_numpy(np.int64), np.array(own["at"].tolist(), np.float64)
    src, dst = np.searchsorted(ids, edges["src"].to_numpy(np.int64)), edges["dst"].to_numpy(np.int64)
    far = np.array(edges["at"].tolist(), np.float64).reshape(len(edges), y.shape[1])
    place = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    inside = ids[place] == dst
    weight = edges["weight"].to_numpy(np.float64)
    rng, (a, b) = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF]), of
    mine = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    here = ids[mine] == names
    for rate in rates:
        on = rng.random(len(src)) < weight
        i, other = src[on], np.where(inside[on, None], y[place[on]], far[on])
        gap = y[i] - other
        d2 = (gap**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
        force = np.zeros_like(y)
        np.add.at(force, i, np.clip(pull[:, None] * gap, -4, 4))
        stands = np.where(here[:, None], y[mine], drawn)
        pick = rng.integers(0, len(names), (len(i), negatives))
        gap = y[i][:, None, :] - stands[pick]
        d2 = (gap**2).sum(2)
        push = np.where(names[pick] == ids[i][:, None], 0.0, 2 * b / ((0.001 + d2) * (1 + a * d2**b)))
        np.add.at(force, i, np.clip(push[:, :, None] * gap, -4, 4).sum(1))
        y = y + rate * force
    return ids, y


def _mover(*how) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, y = _moved(pdf, *how)
        return pd.DataFrame({"id": ids, "at": list(y)})

    return move


def umap(graph: DataFrame, start: DataFrame, epochs: int = 200, rounds: int = 10, rate: float = 1.0, negatives: int = 5, spread: float = 1.0, min_dist: float = 0.1, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """(id, at array): positions from a graph of fuzzy_graph(), with weights up to one, and from starting positions
    (id, at), as of spectral_start().

    Rows are dealt to blocks of about `block_rows` by a hash of the id and of the round, so blocks differ from round to round.
    One join a round brings each edge the position of its other end; then a task moves its block for epochs / rounds passes.
    In a pass an edge pulls its row with the probability of its weight, and `negatives` drawn rows push it; they come from
    DRAWN rows of the whole table, drawn by hash in each round, the only ones that all tasks receive. The rate falls to zero
    over the epochs. Both directions of an edge move their own end, so no position is written by two tasks.

    The result depends on the ids, the weights and the seed, not on how Spark deals the rows, except that a pass adds up in
    floating point. Rows without a starting position are left out, and their edges; rows without edges stay where they are."""
    before, spark = tables(), graph.sparkSession
    dims = start.select(F.max(F.size("at")).alias("d")).first()["d"] or 0
    state = written(start.select(F.col("id").cast("long").alias("id"), F.col("at").cast("array<double>").alias("at")))
    edges = written(graph.filter("src <> dst and weight > 0").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")))
    blocks, of = state.count() // block_rows + 1, curve(spread, min_dist)
    rates = rate * (1 - np.arange(epochs) / epochs)
    for turn, part in enumerate(np.array_split(rates, min(rounds, epochs))):
        sample = state.orderBy(F.xxhash64("id", F.lit(seed + turn)), "id").limit(DRAWN).collect()  # DRAWN rows at most
        if not sample:
            break
        names, drawn = np.array([r["id"] for r in sample], np.int64), np.array([r["at"] for r in sample], np.float64)
        order = np.argsort(names)
        names, drawn = names[order], drawn[order]
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed + turn)), F.lit(blocks)).alias("block")  # noqa: E731, B023
        nodes = state.select(block("id"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("weight"), "at")
        held = edges.join(state.select(F.col("id").alias("src")), "src", "left_semi").join(state.select(F.col("id").alias("dst"), "at"), "dst")
        rows = nodes.unionByName(held.select(block("src"), "src", "dst", "weight", "at"))

        state = written(rows.groupBy("block").applyInPandas(_mover(drawn, names, of, part, negatives, seed + turn), "id long, at array<double>"))
        sweep(spark, before, edges, state)
    return state


def trustworthiness(near: DataFrame, ranks: DataFrame, n: int, k: int) -> float:
    """How far the k neighbours in a layout (id, neighbour) are neighbours before, from 0 to 1: one less the scaled sum of
    rank - k over those beyond the k-th. `ranks` (id, neighbour, rank) holds the ranks before; pairs absent from it count
    with its largest rank plus one, which is exact only if it is complete."""
    most = ranks.agg(F.max("rank")).first()[0] or 0
    j = near.select("id", "neighbour").join(ranks.select("id", "neighbour", "rank"), ["id", "neighbour"], "left")
    far = j.agg(F.sum(F.greatest(F.coalesce("rank", F.lit(most + 1)) - k, F.lit(0))).alias("s")).first()["s"] or 0
    return 1 - 2.0 * far / (n * k * (2 * n - 3 * k - 1))
