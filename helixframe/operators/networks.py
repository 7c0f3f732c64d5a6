"""Which factors explain a gene: importances from boosted histogram trees, grown where the data lie.

Cells are dealt to blocks, and every block grows trees for its share of the target genes from its own cells, so that all
cells take part and no task holds more than a block. Factors are cut into a few bins once a block; a tree sees histograms of
sums by bin only. Rows that a tree does not learn from tell when to stop. Blocks only send sums of gains by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import written

#: Cells of a block and targets of a task, about, and bins of a factor.
BLOCK_CELLS, TASK_TARGETS, BINS = 4_096, 256, 16


def binned(x: np.ndarray) -> np.ndarray:
    """Bins of each column: values by rank among the distinct ones, evenly filled; the least value has bin 0."""
    out = np.zeros(x.shape, np.uint8)
    for j in range(x.shape[1]):
        distinct = np.unique(x[:, j])
        edges = distinct[1:] if len(distinct) <= BINS else np.unique(np.quantile(x[:, j][x[:, j] > distinct[0]], np.arange(BINS - 1) / (BINS - 1)))
        out[:, j] = np.searchsorted(edges, x[:, j], side="right")
    return out


#: Cells times targets times factors that a level of trees counts at once.
COUNTED = 2_000_000


class Booster:
    """Trees for many targets at once over the same binned factors (cells x factors): the targets of a round share the cells
    that learn and the factors that are tried, so their histograms are one count. Of `width` factors that are drawn from,
    `bins` may hold only those at `places`; the others never split."""

    def __init__(self, bins: np.ndarray, depth: int, rate: float, trees: int, patience: int, sample: float, features: float | str, least: int, seed: list[int], places: np.ndarray | None = None, width: int | None = None) -> None:
        self.bins, self.depth, self.rate, self.trees, self.patience, self.sample, self.least, self.seed = bins.astype(np.int64), depth, rate, trees, patience, sample, least, seed
        self.n, self.held = bins.shape
        self.width = width or self.held
        self.column = np.full(self.width, -1)
        self.column[np.arange(self.held) if places is None else places] = np.arange(self.held)
        self.drawn = min(self.width, max(1, round(np.sqrt(self.width) if features == "sqrt" else features * self.width)))

    def importances(self, y: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(sums of gains, targets x factors; trees grown) for targets (cells x targets); `own` is the column of a target
        among the factors, or -1."""
        own = np.full(y.shape[1], -1) if own is None else own
        step = max(1, COUNTED // max(1, self.n * -(-self.drawn * self.held // self.width)))
        done = [self._boosted(y[:, k : k + step], own[k : k + step]) for k in range(0, y.shape[1], step)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _boosted(self, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        many = y.shape[1]
        residual = y - y.mean(axis=0)
        gains, grown, recent = np.zeros((many, self.held)), np.zeros(many, np.int64), np.zeros((self.patience, many))
        live = np.flatnonzero((residual != 0).any(axis=0))
        for k in range(self.trees):
            if not len(live):
                break
            learns = rng.random(self.n) < self.sample
            if learns.all() or not learns.any():
                learns = np.arange(self.n) % 10 > 0
            chosen, out = self.column[rng.choice(self.width, self.drawn, replace=False)], ~learns
            chosen = chosen[chosen >= 0]
            taken_off, gain = self._trees(residual[:, live], learns, chosen, own[live])
            left = residual[:, live]
            recent[k % self.patience, live] = (left[out] ** 2).mean(axis=0) - ((left[out] - taken_off[out]) ** 2).mean(axis=0) if out.any() else 0.0
            residual[:, live] = left - taken_off
            gains[live[:, None], chosen] += gain
            grown[live] += 1
            if k + 1 >= self.patience:  # stop where unseen cells gain no more
                live = live[recent[:, live].mean(axis=0) > 0]
        return gains, grown

    def _trees(self, residual: np.ndarray, learns: np.ndarray, chosen: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what one tree a target takes off the residuals of all cells, gains of the chosen factors)."""
        many, wide, rows = residual.shape[1], len(chosen), np.flatnonzero(learns)
        bins, on = self.bins[:, chosen], np.arange(many)
        leaf, gains = np.zeros((self.n, many), np.int64), np.zeros((many, wide))
        for level in range(self.depth if wide else 0):
            nodes, each, at_node = 1 << level, np.arange(len(on)), leaf[:, on]
            at = ((at_node[rows] + nodes * each)[:, :, None] * wide + np.arange(wide)) * BINS + bins[rows][:, None, :]
            size, shape = len(on) * nodes * wide * BINS, (len(on), nodes, wide, BINS)
            count = np.bincount(at.ravel(), minlength=size).reshape(shape)
            total = np.bincount(at.ravel(), weights=np.repeat(residual[np.ix_(rows, on)].ravel(), wide), minlength=size).reshape(shape)
            left_n, left = count.cumsum(axis=3)[..., :-1], total.cumsum(axis=3)[..., :-1]
            all_n, all_ = count.sum(axis=3, keepdims=True), total.sum(axis=3, keepdims=True)
            right_n, right = all_n - left_n, all_ - left
            good = (left_n >= self.least) & (right_n >= self.least) & (chosen != own[on, None])[:, None, :, None]
            gain = left**2 / np.maximum(left_n, 1) + right**2 / np.maximum(right_n, 1) - all_**2 / np.maximum(all_n, 1)
            gain = np.where(good, gain, 0.0).reshape(len(on), nodes, -1)
            best = gain.argmax(axis=2)
            most = np.take_along_axis(gain, best[:, :, None], axis=2)[:, :, 0]
            split, edge, taken = best // (BINS - 1), best % (BINS - 1), most > 1e-12
            np.add.at(gains, (np.repeat(on, nodes), split.ravel()), np.where(taken, most, 0.0).ravel())
            side = bins[np.arange(self.n)[:, None], split[each, at_node]] > edge[each, at_node]
            leaf *= 2
            leaf[:, on] += side & taken[each, at_node]
            on = on[taken.any(axis=1)]  # what is not split now is not split by the same factors below either
            if not len(on):
                leaf <<= self.depth - 1 - level
                break
        size = 1 << self.depth
        each = np.arange(many)
        at = (leaf[rows] + size * each).ravel()
        mean = np.bincount(at, weights=residual[rows].ravel(), minlength=many * size) / np.maximum(np.bincount(at, minlength=many * size), 1)
        return self.rate * mean.reshape(many, size)[each, leaf], gains


def factor_importances(expr: DataFrame, factors: DataFrame, trees: int = 150, depth: int = 3, rate: float = 0.1, patience: int = 10, sample: float = 0.9, features: float | str = "sqrt", least: int = 10, cells: int | None = None, seed: int = 42) -> DataFrame:
    """(tf, gene, importance) of expression (cell, gene, value), zeros left out, for the factors (tf) and all genes: the part
    of a gene's explained variance that splits on the factor explain, summing to 1 for each gene; a gene does not explain
    itself, and pairs without a gain have no row.

    A block of about BLOCK_CELLS cells, dealt by a hash, grows at most `trees` trees a gene, each from `sample` of the
    block's cells and a part of the factors ("sqrt" or a share), and stops when the left-out cells have not gained over
    `patience` trees. Factors travel once for each TASK_TARGETS genes of a block. `cells` is the number of all cells, where
    some have no counts and so no rows. Results depend on the seed, not on partitions.

    A split has at least `least` cells on either side and all zeros on one, so a factor of fewer cells in a block never
    splits there: it is drawn as any other but does not travel, and blocks without other factors grow nothing. Genes that
    few cells express need `least` times the number of blocks of them to be told from chance."""
    tf = factors.select(F.col("tf").alias("gene")).distinct()
    expr = written(expr.groupBy("cell", "gene").agg(F.sum("value").cast("double").alias("value")))
    n = cells or expr.select("cell").distinct().count()
    blocks = max(1, round(n / BLOCK_CELLS))
    parts = expr.select("gene").distinct().count() // TASK_TARGETS + 1
    rows = expr.withColumn("block", F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(blocks)))
    by = written(rows.join(tf, "gene", "left_semi"))
    of = Window.partitionBy("block")  # a row a factor
    width = by.groupBy("block", "gene").agg(F.count("*").alias("held")).withColumns({"place": (F.row_number().over(of.orderBy("gene")) - 1).cast("long"), "width": F.count("*").over(of)})
    useful = written(width.filter(F.col("held") >= least).select("block", "gene", "place", "width"))
    grown = useful.select("block").distinct()
    told = lambda place, width: (place.cast("long").alias("place"), width.cast("long").alias("width"))
    targets = rows.join(grown, "block", "left_semi").select("block", "cell", "gene", "value", F.pmod(F.xxhash64("gene", F.lit(seed)), F.lit(parts)).alias("part"), *told(F.lit(-1), F.lit(0)))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).alias("part")
    splits = by.join(useful, ["block", "gene"]).select("block", "cell", "gene", "value", every, *told(F.col("place"), F.col("width")))
    # All cells with a factor keep their places among the cells that learn.
    others = by.join(grown, "block", "left_semi").groupBy("block", "cell").agg(F.min("gene").alias("gene")).select("block", "cell", "gene", F.lit(0.0).alias("value"), every, *told(F.lit(-2), F.lit(0)))
    share = n / blocks
    kind = expr.schema["gene"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"tf": pdf["gene"].iloc[:0], "gene": pdf["gene"].iloc[:0], "gain": np.zeros(0)})
        cell, names = np.unique(pdf["cell"], return_inverse=True)
        size = max(len(cell), round(share) if cells else 0)  # cells without counts are rows of zeros
        place = pdf["place"].to_numpy(np.int64)
        of, target = place >= 0, place == -1
        value = pdf["value"].to_numpy(np.float64)
        if not target.any():
            return empty
        places, first, col = np.unique(place[of], return_index=True, return_inverse=True)
        tfs = pdf["gene"].to_numpy()[of][first]
        x = np.zeros((size, len(tfs)))
        x[names[of], col] = value[of]
        bins = binned(x)
        genes, which = np.unique(pdf["gene"].to_numpy()[target], return_inverse=True)
        y = np.zeros((size, len(genes)))
        y[names[target], which] = value[target]
        at = {gene: k for k, gene in enumerate(tfs)}
        own = np.array([at.get(gene, -1) for gene in genes])
        width = int(pdf["width"].max())
        booster = Booster(bins, depth, rate, trees, patience, sample, features, least, [seed, int(pdf["block"].iloc[0]), int(pdf["part"].iloc[0])], places, width)
        gains, _ = booster.importances(y, own)
        gains /= np.maximum(((y - y.mean(axis=0)) ** 2).sum(axis=0), 1e-300)[:, None]
        g, f = np.nonzero(gains)
        return pd.DataFrame({"tf": tfs[f], "gene": genes[g], "gain": gains[g, f]})

    both = targets.unionByName(splits).unionByName(others)
    gains = both.groupBy("block", "part").applyInPandas(run, f"tf {kind}, gene {kind}, gain double")
    pairs = gains.groupBy("tf", "gene").agg(F.sum("gain").alias("gain"))
    total = pairs.groupBy("gene").agg(F.sum("gain").alias("all__"))
    return pairs.join(total, "gene").select("tf", "gene", (F.col("gain") / F.col("all__")).alias("importance"))
