"""Gene set enrichment with p-values far below one over the number of permutations, by adaptive multilevel splitting.

The null distribution of an enrichment score depends on the statistics of a contrast and the size of a set only, so sets
that share both share a task. Plain draws give the mode, the mean and common p-values. For rare scores a sample of random
sets is driven upwards: a level lies at the middle of the sample's scores, sets below it are replaced by copies of those
above, and copies are spread by a Markov chain that swaps members and rejects what falls below the level. Each level costs
the same and about halves the probability.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranks import bh_adjusted
from helixframe.operators.enrichment import gsea_statistic, placed
from helixframe.session import cut, written

#: Random numbers that are drawn at a time.
_DRAWN = 4_000_000
#: Statistics that travel in one row.
CHUNK = 65_536
#: Tasks among which the sizes of a contrast are dealt; each receives the contrast's statistics once.
DEALT = 16


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + math.log(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out, x = out + 1 / (x * x), x + 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42))


def deviations(sets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest running sum of each row of places (from 0) in the order of falling statistics."""
    at = np.sort(sets, axis=1)
    m, n = at.shape[1], len(weights)
    part = weights[at]
    total = part.sum(axis=1, keepdims=True)
    part = np.where(total > 0, part / np.where(total > 0, total, 1), 1 / m)
    run = np.cumsum(part, axis=1)
    miss = (at - np.arange(m)) / (n - m)
    return (run - miss).max(axis=1), (run - part - miss).min(axis=1)


def scores(sets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    high, low = deviations(sets, weights)
    return np.where(high > -low, high, np.where(high < -low, low, 0.0))


def drawn_sets(rng: np.random.Generator, count: int, m: int, n: int) -> np.ndarray:
    """Random sets of m of n places, a set a row."""
    step = max(1, _DRAWN // n)
    return np.concatenate([np.argpartition(rng.random((min(step, count - k), n)), m - 1, axis=1)[:, :m] for k in range(0, count, step)])


def simple_error(more: int, draws: int) -> float:
    """Standard deviation of log2 of a p-value from plain draws of which `more` lie beyond the score."""
    return math.sqrt(max(0.0, trigamma(more + 1) - trigamma(draws + 1))) / math.log(2)


def multilevel_error(log2p: float, sample: int) -> float:
    """The same for a p-value from levels that halve it."""
    return math.sqrt(max(1, math.floor(-log2p + 1)) * (trigamma((sample + 1) / 2) - trigamma(sample + 1))) / math.log(2)


def rare_probabilities(weights: np.ndarray, m: int, targets: list[float], sample: int, eps: float, rng: np.random.Generator, sweeps: int = 10) -> list[float]:
    """log of P(high >= target and high > -low) for each positive target, of random sets of m places; log of `eps` for what
    is rarer than that."""
    n = len(weights)
    sets = drawn_sets(rng, sample, m, n)
    high, low = deviations(sets, weights)
    log_p, out, left = 0.0, [math.log(eps)] * len(targets), sorted(range(len(targets)), key=lambda i: targets[i])
    rows = np.arange(sample)
    while left and log_p > math.log(eps):
        # Targets that half of the sample reaches, or nearly, are told from the sample.
        levels = np.unique(high)
        level = np.sort(high)[(sample - 1) // 2]
        if (high >= level).sum() > 0.75 * sample and (levels > level).any():  # many are equal: the next level
            level = levels[levels > level][0]
        while left and (targets[left[0]] < level or level <= levels[0]):
            i = left.pop(0)
            beyond = int(((high >= targets[i] - 1e-12) & (high > -low)).sum())
            if beyond:
                out[i] = log_p + digamma(beyond) - digamma(sample + 1) if beyond < sample else log_p
        if not left:
            break
        alive = np.flatnonzero(high >= level)
        log_p += digamma(len(alive)) - digamma(sample + 1) if len(alive) < sample else 0.0
        chosen = np.concatenate([alive, rng.choice(alive, sample - len(alive))])
        sets, high, low = sets[chosen], high[chosen], low[chosen]
        accepted, steps = 0, 0
        while (accepted < m * sample or steps < 2 * m) and steps < sweeps * m + 50:
            steps += 1
            j, g = rng.integers(m, size=sample), rng.integers(n, size=sample)
            new = sets.copy()
            new[rows, j] = g
            h, l = deviations(new, weights)
            good = (h >= level) & ~(sets == g[:, None]).any(axis=1)
            sets[good], high[good], low[good] = new[good], h[good], l[good]
            accepted += int(good.sum())
    return out


def _of_one_size(weights: np.ndarray, m: int, es: list[float], draws: int, sample: int, eps: float, seed: int) -> list[tuple[float, float, float]]:
    """(nes, pval, log2err) of each score of sets of m features."""
    n = len(weights)
    rng = np.random.default_rng([seed, m, n])
    null = scores(drawn_sets(rng, draws, m, n), weights)
    up, down = int((null >= 0).sum()), int((null <= 0).sum())
    mean_up, mean_down = (null[null >= 0].mean() if up else math.nan), (-null[null <= 0].mean() if down else math.nan)
    out, rare = [], {1: [], -1: []}
    for k, e in enumerate(es):
        side, mean = (up, mean_up) if e >= 0 else (down, mean_down)
        more = int((null >= e).sum() if e >= 0 else (null <= e).sum())
        p = (more + 1) / (side + 1)
        err = simple_error(more, draws)
        if e != 0 and multilevel_error(math.log2((more + 1) / (draws + 1)), sample) < err:
            rare[1 if e > 0 else -1].append(k)
        out.append((e / mean if mean and mean == mean else math.nan, min(1.0, p), err))
    for sign, own in rare.items():
        if not own:
            continue
        w = weights if sign > 0 else weights[::-1]  # the smallest sum is the largest of the reversed order
        share = ((up if sign > 0 else down) + 1) / (draws + 1)
        for k, log_p in zip(own, rare_probabilities(w, m, [abs(es[k]) for k in own], sample, eps, rng), strict=True):
            known = log_p > math.log(eps)
            p = math.exp(log_p) / share if known else eps
            out[k] = (out[k][0], min(1.0, p), multilevel_error(log_p / math.log(2), sample) if known else math.nan)
    return out


def multilevel_enrichment(stats: DataFrame, sets: DataFrame, permutations: int = 1000, sample: int = 101, eps: float = 1e-50, power: float = 1.0, min_size: int = 5, max_size: int = 500, seed: int = 42, ranked: DataFrame | None = None) -> DataFrame:
    """(contrast, set_id, size, es, nes, pval, log2err, fdr): gsea_statistic() with p-values among random sets of the same
    size and sign, and the standard deviation of their log2.

    `permutations` plain draws come first; where their error is larger than that of `sample` sets driven up by levels, those
    tell the p-value, down to `eps`, below which it is eps and its error null. A task has the sets of a share of the sizes of
    one contrast, with the contrast's statistics, which travel in rows of CHUNK and once a task; no row is made for a draw.
    Results depend on the seed, not on partitions. `ranked` is what placed() gives of the statistics, if it is at hand."""
    ranked = ranked if ranked is not None else placed(stats)
    real = gsea_statistic(stats, sets, power, min_size, max_size, ranked)
    deal = F.pmod(F.xxhash64("size"), F.lit(DEALT)).alias("deal")
    group = written(real.groupBy("contrast", "size").agg(F.array_sort(F.collect_list(F.struct("set_id", "es"))).alias("found")).withColumn("deal", deal))
    pair = F.struct("at", F.pow(F.abs("stat"), F.lit(power)).alias("w"))
    chunks = ranked.groupBy("contrast", F.floor((F.col("at") - 1) / CHUNK).alias("part")).agg(F.array_sort(F.collect_list(pair)).alias("order"))
    chunks = chunks.select("contrast", "part", F.transform("order", lambda x: x["w"]).alias("weights")).join(group.select("contrast", F.col("deal").alias("to")).distinct(), "contrast")
    told = "contrast {0}, size long, at int, nes double, pval double, log2err double".format(stats.schema["contrast"].dataType.simpleString())

    def run(own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        weights = np.concatenate([np.asarray(w, np.float64) for w in parts.sort_values("part")["weights"]]) if len(parts) else np.zeros(0)
        done = []
        for r in own.itertuples():
            rows = _of_one_size(weights, int(r.size), [float(x["es"]) for x in r.found], permutations, sample, eps, seed)
            done.append(pd.DataFrame({"contrast": [r.contrast] * len(rows), "size": r.size, "at": range(len(rows)), "nes": [x[0] for x in rows], "pval": [x[1] for x in rows], "log2err": [x[2] for x in rows]}))
        return pd.concat(done) if done else pd.DataFrame({"contrast": [], "size": [], "at": [], "nes": [], "pval": [], "log2err": []})

    got = group.groupBy("contrast", "deal").cogroup(chunks.groupBy("contrast", "to")).applyInPandas(run, told)
    named = group.select("contrast", "size", F.posexplode("found").alias("at", "x")).select("contrast", "size", "at", F.col("x.set_id").alias("set_id"), F.col("x.es").alias("es"))
    out = named.join(got, ["contrast", "size", "at"])
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("nes", "log2err")})
    fdr = bh_adjusted(F.col("pval"), ["contrast"], F.count("pval").over(Window.partitionBy("contrast")), ["set_id"])
    return out.withColumn("fdr", fdr).select("contrast", "set_id", "size", "es", "nes", "pval", "log2err", "fdr")


def multilevel_elimination(stats: DataFrame, terms: DataFrame, ancestry: DataFrame, levels: list[int], elim_threshold: float = 0.05, **more) -> DataFrame:
    """(contrast, term, level, size, es, nes, pval, log2err, fdr): multilevel_enrichment() from the deepest level up; the
    members of a significant term leave all its ancestors, in that contrast only. The fdr is adjusted over all levels of a
    contrast. One step per level of the ontology."""
    from functools import reduce

    gone, done, ranked = None, [], placed(stats)
    for level in sorted(levels, reverse=True):
        mine = terms.filter(F.col("level") == level).select(F.col("term").alias("set_id"), "member").distinct()
        own = ranked.select("contrast").distinct().crossJoin(mine)  # a contrast has its own sets
        own = own.join(gone, ["contrast", "set_id", "member"], "left_anti") if gone is not None else own
        n = cut(multilevel_enrichment(stats, own, ranked=ranked, **more).drop("fdr").withColumnRenamed("set_id", "term").withColumn("level", F.lit(level)))
        done.append(n)
        found = n.filter(F.col("pval") <= elim_threshold).select("contrast", F.col("term").alias("set_id"))
        new = found.join(mine, "set_id").join(ancestry.filter("term <> ancestor").withColumnRenamed("term", "set_id"), "set_id").select("contrast", F.col("ancestor").alias("set_id"), "member").distinct()
        gone = cut(new if gone is None else gone.unionByName(new).distinct())
    out = reduce(DataFrame.unionByName, done)
    fdr = bh_adjusted(F.col("pval"), ["contrast"], F.count("pval").over(Window.partitionBy("contrast")), ["term"])
    return out.withColumn("fdr", fdr).select("contrast", "term", "level", "size", "es", "nes", "pval", "log2err", "fdr")
