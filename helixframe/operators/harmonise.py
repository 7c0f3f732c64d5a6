"""Batch correction by soft clusters, a reference of it to map other cells on, and components of sparse expression.

Per round each task adds up small matrices (clusters x batches x dimensions); only those reach the driver, whose state is
broadcast. Cells never leave their tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graphs import _centres
from helixframe.session import cut


def _summed(df: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over tasks of the array that `of` makes from each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = of(b)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    rows = df.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(int(np.prod(shape)))
    for r in rows:
        out[r["i"]] = r["x"]
    return out.reshape(shape)


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(b.column(name).to_pylist(), np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _soft(x: np.ndarray, centres: np.ndarray, sigma: float, penalty: np.ndarray | None = None, batch: np.ndarray | None = None) -> np.ndarray:
    """Shares of the clusters for each row, by cosine; `penalty` (clusters x batches) lowers clusters that the row's batch
    already fills."""
    logit = -2 * (1 - _unit(x) @ centres.T) / sigma
    r = np.exp(logit - logit.max(1, keepdims=True))
    if penalty is not None:
        r = r * penalty[:, batch].T
    return r / r.sum(1, keepdims=True)


def harmony(vectors: DataFrame, batches: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float | None = 1.0, rounds: int = 10, inner: int = 10, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """(id, embedding): vectors (id, embedding) without what batches (id, label) add to them.

    Rows are softly clustered by cosine, with a penalty `theta` on clusters in which their batch is over its share, and
    in each cluster the offset of every batch from the cluster's mean is estimated with a ridge and taken off. A null
    `ridge` takes a fifth of the rows that the batch is expected to have in a cluster, so small batches are moved less.
    First centres come from at most `sample` rows drawn by a seeded hash; rounds stop once offsets change by less than
    a thousandth. Batches and clusters are few."""
    names = [r[0] for r in batches.select("label").distinct().orderBy("label").collect()]
    place = {n: i for i, n in enumerate(names)}
    lookup = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))
    rows = cut(vectors.join(batches.select("id", "label"), "id").select("id", F.col("embedding").cast("array<double>").alias("embedding"), lookup[F.col("label")].cast("int").alias("batch")))
    n = rows.groupBy("batch").count().collect()
    size = np.zeros(len(names))
    for r in n:
        size[r["batch"]] = r["count"]
    if not len(names):
        return rows.select("id", "embedding")
    share = size / size.sum()
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").collect()])
    k = clusters or max(1, min(100, int(size.sum() / 30)))
    centres = _unit(_centres(_unit(drawn), k, seed))
    k, d, nb = len(centres), drawn.shape[1], len(names)
    offsets, penalty, before = np.zeros((k, nb, d)), np.ones((k, nb)), None

    def corrected(b: pa.RecordBatch, offsets: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        """Rows less the offsets of their clusters, with shares from the vectors as they were."""
        x, own = _matrix(b, "embedding"), b.column("batch").to_numpy(zero_copy_only=False)
        return x - np.einsum("nk,knd->nd", _soft(x, centres, sigma, penalty, own), offsets[:, own])

    for _ in range(rounds):
        for _ in range(inner):
            def moments(b: pa.RecordBatch, c=centres, p=penalty, o=offsets) -> np.ndarray:
                x, own = _matrix(b, "embedding"), b.column("batch").to_numpy(zero_copy_only=False)
                r = _soft(x, c, sigma, p, own)
                moved = _unit(x - np.einsum("nk,knd->nd", r, o[:, own]))
                out = np.zeros((k, nb + d))
                for i in range(nb):
                    out[:, i] = r[own == i].sum(0)
                out[:, nb:] = r.T @ moved
                return out

            m = _summed(rows, moments, (k, nb + d))
            centres = _unit(m[:, nb:])
            seen = m[:, :nb]
            expected = seen.sum(1, keepdims=True) * share
            # All rows move at once, so the penalty follows in part only; else batches would swap clusters back and forth.
            penalty = penalty**0.8 * ((expected + 1) / (seen + 1)) ** (0.2 * theta)

        def by_batch(b: pa.RecordBatch, c=centres, p=penalty) -> np.ndarray:
            x, own = _matrix(b, "embedding"), b.column("batch").to_numpy(zero_copy_only=False)
            r = _soft(x, c, sigma, p, own)
            out = np.zeros((k, nb, d + 1))
            for i in range(nb):
                out[:, i, :d], out[:, i, d] = r[own == i].T @ x[own == i], r[own == i].sum(0)
            return out

        s = _summed(rows, by_batch, (k, nb, d + 1))
        weight, sums = s[:, :, d], s[:, :, :d]
        mean = sums.sum(1) / np.maximum(weight.sum(1), 1e-12)[:, None]
        lam = ridge if ridge is not None else 0.2 * weight.sum(1, keepdims=True) * share
        offsets = (sums - weight[:, :, None] * mean[:, None, :]) / (weight + lam)[:, :, None]
        if before is not None and np.abs(offsets - before).max() <= 1e-3 * max(np.abs(offsets).max(), 1e-12):
            break
        before = offsets

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(corrected(b, offsets, centres, penalty).tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

    return rows.mapInArrow(run, "id long, embedding array<double>")


@dataclass
class Reference:
    """Soft clusters of a corrected reference: centres, the rows in each and the sums of their vectors."""

    centres: np.ndarray
    weight: np.ndarray
    sums: np.ndarray
    sigma: float


def build_reference(vectors: DataFrame, clusters: int = 50, sigma: float = 0.1, sample: int = 20_000, seed: int = 42) -> Reference:
    """Of vectors (id, embedding) that are corrected already; clusters are few and fitted on a bounded sample."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("embedding").collect()])
    centres = _unit(_centres(_unit(drawn), clusters, seed))

    def of(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, "embedding")
        r = _soft(x, centres, sigma)
        return np.concatenate((r.T @ x, r.sum(0)[:, None]), axis=1)

    s = _summed(rows, of, (len(centres), drawn.shape[1] + 1))
    return Reference(centres, s[:, -1], s[:, :-1], sigma)


def map_query(vectors: DataFrame, reference: Reference, ridge: float = 1.0) -> DataFrame:
    """(id, embedding): cells of a query moved onto a reference: in each cluster the query's offset from the reference's
    mean, shrunk by a ridge, is taken off in proportion to the share that the cell has in it."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    c, sigma = reference.centres, reference.sigma

    def of(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b, "embedding")
        r = _soft(x, c, sigma)
        return np.concatenate((r.T @ x, r.sum(0)[:, None]), axis=1)

    s = _summed(rows, of, (len(c), c.shape[1] + 1))
    mean = reference.sums / np.maximum(reference.weight, 1e-12)[:, None]
    offsets = (s[:, :-1] - s[:, -1:] * mean) / (s[:, -1:] + ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b, "embedding")
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((x - _soft(x, c, sigma) @ offsets).tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

    return rows.mapInArrow(run, "id long, embedding array<double>")


def projected_anchors(vectors: DataFrame, reference: DataFrame, k: int, dims: int = 20) -> DataFrame:
    """(a, b, distance): mutual nearest neighbours of two batches after each is projected on the other's components: rows of
    `vectors` in the basis of `reference` and the other way round, side by side."""
    from helixframe.operators.graphs import gram
    from helixframe.operators.integration import mutual_neighbours

    def basis(t: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n, s, g = gram(t)
        values, v = np.linalg.eigh((g - np.outer(s, s) / n) / max(n - 1, 1))
        return s / n, v[:, np.argsort(values)[::-1][:dims]]

    (mu_a, a), (mu_b, b) = basis(vectors), basis(reference)
    both = np.concatenate((a, b), axis=1)

    def placed(mu: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if x.num_rows:
                    yield pa.RecordBatch.from_arrays([x.column("id"), pa.array(_unit((_matrix(x, "embedding") - mu) @ both).tolist(), pa.list_(pa.float64()))], names=["id", "embedding"])

        return run

    schema = "id long, embedding array<double>"
    return mutual_neighbours(vectors.select("id", "embedding").mapInArrow(placed(mu_a), schema), reference.select("id", "embedding").mapInArrow(placed(mu_b), schema), k)


def expression_components(norm: DataFrame, genes: DataFrame, n_cells: int, k: int, scale: bool = True) -> DataFrame:
    """(cell, pc) of all cells with a chosen gene: scores on the first components of centred and scaled expression (cell,
    gene, norm) of chosen genes (gene, at most some thousands), zeros left out.

    Sparse cells give one matrix of genes squared a task, added up pair by pair; centring and scaling enter as closed
    forms, so no zeros are made. Constant genes are left out."""
    names = [r[0] for r in genes.select("gene").distinct().orderBy("gene").collect()]
    d = len(names)
    at = norm.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], f"gene {genes.schema['gene'].dataType.simpleString()}, i int")
    rows = norm.join(F.broadcast(at), "gene").groupBy("cell").agg(F.collect_list("i").alias("i"), F.collect_list("norm").alias("x"))
    rows = cut(rows)

    def of(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((d + 1, d))
        x = np.zeros((b.num_rows, d))
        lists = b.column("i")
        owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        x[owner, lists.flatten().to_numpy(zero_copy_only=False)] = b.column("x").flatten().to_numpy(zero_copy_only=False)
        out[0], out[1:] = x.sum(0), x.T @ x
        return out

    m = _summed(rows, of, (d + 1, d))
    mu = m[0] / n_cells
    cov = (m[1:] - n_cells * np.outer(mu, mu)) / (n_cells - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    good = sd > 1e-12
    unit = np.where(good, sd, 1.0) if scale else np.ones(d)
    cov = np.where(good[:, None] & good[None, :], cov / np.outer(unit, unit), 0)
    values, basis = np.linalg.eigh(cov)
    basis = basis[:, np.argsort(values)[::-1][:k]]
    basis = basis * np.where(basis.sum(0) < 0, -1.0, 1.0) * good[:, None]
    loading = basis / unit[:, None]
    base = mu @ loading

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column("i")
                owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                pc = np.tile(-base, (b.num_rows, 1))
                np.add.at(pc, owner, b.column("x").flatten().to_numpy(zero_copy_only=False)[:, None] * loading[lists.flatten().to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(pc.tolist(), pa.list_(pa.float64()))], names=["cell", "pc"])

    return rows.mapInArrow(run, "cell long, pc array<double>")
