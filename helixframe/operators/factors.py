"""Factor models of embeddings (id, embedding): independent components and non-negative factors.

The rows stay where they are. An iteration is one pass in which each task turns its rows into one small matrix of sums;
these are added up by Spark, and only the sum, of the size of dimensions times components, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graphs import gram


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("embedding").to_pylist(), np.float64)


def summed(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of f(rows) over all rows, f giving a matrix of `shape`. Without rows it is zero."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b))
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0])), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    rows = vectors.select("embedding").mapInArrow(part, "i long, v array<double>")
    out = np.zeros(shape)
    for r in rows.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"]
    return out


def mapped(vectors: DataFrame, f: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(id, name): f(rows), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(f(_matrix(b)).tolist(), pa.list_(pa.float64()))], names=["id", name])

    return vectors.select("id", "embedding").mapInArrow(run, f"id long, {name} array<double>")


def _orthogonal(w: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(w)
    return u @ vt


def independent_components(vectors: DataFrame, k: int, how: str = "logcosh", rounds: int = 200, tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """(id, ic): FastICA with symmetric decorrelation on whitened embeddings; contrast `logcosh` or `exp`. Each component
    has variance one, and the sign that makes its third moment positive. Rows without an embedding are left out; k is
    at most the rank of the data."""
    vectors = vectors.filter("embedding is not null")
    n, s, g = gram(vectors)
    if n < 2:
        return mapped(vectors.limit(0), lambda x: x, "ic")
    mu = s / n
    values, basis = np.linalg.eigh((g - n * np.outer(mu, mu)) / n)
    best = np.argsort(values)[::-1][:k]
    best = best[values[best] > values.max() * 1e-10]
    k, white = len(best), basis[:, best] / np.sqrt(values[best])
    w = _orthogonal(np.random.default_rng(seed).normal(size=(k, k)))

    def step(w: np.ndarray) -> np.ndarray:
        def sums(x: np.ndarray) -> np.ndarray:
            z = (x - mu) @ white
            y = z @ w.T
            if how == "logcosh":
                a = np.tanh(y)
                b = 1 - a * a
            else:
                e = np.exp(-y * y / 2)
                a, b = y * e, (1 - y * y) * e
            return np.vstack((a.T @ z, b.sum(0)))

        got = summed(vectors, sums, (k + 1, k)) / n
        return _orthogonal(got[:k] - got[k][:, None] * w)

    for _ in range(rounds):
        new = step(w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    third = summed(vectors, lambda x: (((x - mu) @ white @ w.T) ** 3).sum(0, keepdims=True), (1, k))[0]
    turn = w.T * np.where(third < 0, -1.0, 1.0)
    return mapped(vectors, lambda x: (x - mu) @ white @ turn, "ic")


def _weights(x: np.ndarray, h: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative w that makes w @ h close to x: coordinate descent, each row by itself."""
    hh, xh = h @ h.T, x @ h.T
    w = np.full((len(x), len(h)), 1e-3)
    for _ in range(sweeps):
        for j in range(len(h)):
            w[:, j] = np.maximum(0, w[:, j] + (xh[:, j] - w @ hh[:, j]) / max(hh[j, j], 1e-12))
    return w


def nonnegative_factors(vectors: DataFrame, k: int, rounds: int = 30, sweeps: int = 20, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((id, weights), factors) with embedding ~ weights @ factors, all of them non-negative, by alternating coordinate
    descent. A row's weights follow from the factors alone, so nothing but the factors is carried between passes and a
    lost task is simply run again. Factors sum to one. Negative entries of embeddings count as zero."""
    vectors = vectors.filter("embedding is not null")
    size = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    h = np.random.default_rng(seed).random((k, size)) + 0.1
    for _ in range(rounds if size else 0):

        def sums(x: np.ndarray, h: np.ndarray = h) -> np.ndarray:
            x = np.maximum(x, 0)
            w = _weights(x, h, sweeps)
            return np.hstack((w.T @ w, w.T @ x))

        got = summed(vectors, sums, (k, k + size))
        ww, wx, h = got[:, :k], got[:, k:], h.copy()
        for _ in range(sweeps):
            for j in range(k):
                h[j] = np.maximum(1e-12, h[j] + (wx[j] - ww[j] @ h) / max(ww[j, j], 1e-12))
        h = h / h.sum(1, keepdims=True)
    return mapped(vectors, lambda x: _weights(np.maximum(x, 0), h, sweeps), "weights"), h


def factor_loss(vectors: DataFrame, factors: np.ndarray, sweeps: int = 20) -> float:
    """Summed squared difference of embeddings, negative entries as zero, from weights @ factors."""

    def off(x: np.ndarray) -> np.ndarray:
        x = np.maximum(x, 0)
        return np.array([[((x - _weights(x, factors, sweeps) @ factors) ** 2).sum()]])

    return float(summed(vectors.filter("embedding is not null"), off, (1, 1))[0, 0])


def restarted_factors(vectors: DataFrame, k: int, runs: int = 10, rounds: int = 30, seed: int = 1) -> tuple[DataFrame, dict[int, float], list[np.ndarray]]:
    """((id, weights) of the run with the smallest loss, loss of each run, factors of each run) of nonnegative_factors() from
    as many random starts. Runs follow each other; each spreads over all tasks and carries nothing but its factors."""
    done = [nonnegative_factors(vectors, k, rounds, seed=seed + i) for i in range(runs)]
    losses = {seed + i: factor_loss(vectors, h) for i, (_, h) in enumerate(done)}
    return done[min(losses, key=losses.get) - seed][0], losses, [h for _, h in done]


def stability(runs: list[np.ndarray]) -> np.ndarray:
    """Of each factor of the first run the mean, over the other runs, of its largest absolute correlation with one of
    theirs: 1 where every start finds it again."""
    first = runs[0]
    best = [np.abs(np.corrcoef(first, h)[: len(first), len(first) :]).max(1) for h in runs[1:]]
    return np.mean(best, axis=0) if best else np.ones(len(first))


def singular_vectors(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """((id, u), singular values) of the matrix of embeddings as it is, uncentred: the right side comes from sums of outer
    products, dimensions squared, and each row is projected on it. Signs make each right vector sum up positive; values
    that are null within rounding are left out."""
    vectors = vectors.filter("embedding is not null")
    _, _, g = gram(vectors)
    values, basis = np.linalg.eigh(g)
    best = np.argsort(values)[::-1][:k]
    best = best[values[best] > max(values.max(), 0) * 1e-12]
    basis, s = basis[:, best], np.sqrt(values[best])
    basis = basis * np.where(basis.sum(0) < 0, -1.0, 1.0)
    return mapped(vectors, lambda x: x @ basis / s, "u"), s
