"""Embedding whitening from an exact integer scatter.

Entries become integers by a rule (floor(64 c) + 1,000,000). Tasks subtract a shift and accumulate n, the sums S and the
cross-products XᵀX of distinct vectors without rounding: vectors are cut into digits of 20 bits, so that products of a
block are exact in floating-point matrix products, and the blocks' products are added as Python integers. What tasks have
accumulated travels as limbs of 32 bits, one row an entry, and is summed by Spark. n·XᵀX − SSᵀ is formed in integers, and
only its quotient by n² becomes floats, once, for eigh. The driver holds dimensions squared numbers, never vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import batch_of, text_bytes, written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Entries beyond this, after scaling, count as this: so they stay 64-bit integers.
LARGEST = 2**62
#: Bits of a digit and rows of a block: 2 * 20 bits and 12 bits of rows stay below the 53 bits of a double.
DIGIT, BLOCK = 20, 4096
#: Blocks whose products are added as 64-bit integers before they become Python integers.
HELD = 128
LIMBS = 8
_WIDTHS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


@dataclass
class Model:
    """What fit() has learned. mean is S / n of the shifted integers, as S and n; directions has a component a row."""

    n: int
    sums: list[int]
    directions: np.ndarray = field(repr=False)
    eigenvalues: np.ndarray = field(repr=False)
    explained: list[float] = field(repr=False)
    identity_error: float = 0.0

    @property
    def real(self) -> np.ndarray:
        """Components with a variance that rounding does not explain; the others can't be whitened."""
        e = self.eigenvalues
        return e > len(self.sums) * np.finfo(float).eps * e.max(initial=0.0)


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, x): the shifted integers floor(scale * c) in as few bytes as the vector allows, trailing zeros left
    out, so that equal vectors have equal bytes. Vectors that are null or hold null or non-finite entries go."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema["vec_id"], T.StructField("dims", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of = batch.column(1)
            sizes = rows_of.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = rows_of.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
            good = sizes >= 0
            good[owner[~np.isfinite(flat)]] = False
            start = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            for dims in np.unique(sizes[good]).tolist():
                at = np.flatnonzero(good & (sizes == dims))
                c = flat[start[at][:, None] + np.arange(dims)]
                with np.errstate(over="ignore"):  # an infinite product is held below as well
                    x = np.clip(np.floor(scale * c), -float(LARGEST), float(LARGEST)).astype(np.int64)
                trimmed = ((x != 0) * np.arange(1, dims + 1)).max(axis=1, initial=0)
                most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
                width = 1 << np.searchsorted([2**7, 2**15, 2**31], most, side="right")
                for t, w in np.unique(np.stack([trimmed, width]), axis=1).T.tolist():
                    own = np.flatnonzero((trimmed == t) & (width == w))
                    body = np.ascontiguousarray(x[own][:, :t].astype(f"<i{w}")).view(np.uint8).reshape(len(own), t * w)
                    body = np.concatenate([np.full((len(own), 1), w, np.uint8), body], axis=1)
                    ends = pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * body.shape[1])
                    cells = pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(body.tobytes())])
                    out = pa.schema([batch.schema.field(0), ("dims", pa.int32()), ("x", pa.binary())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[own])), pa.array(np.full(len(own), dims, np.int32)), cells], schema=out)

    return rows.mapInArrow(pack, schema)


def unpacked(cells: pa.Array, dims: int) -> np.ndarray:
    """The integers of a column that packed() has made, a vector a row, zeros behind shorter ones."""
    data, ends = text_bytes(cells)
    out = np.zeros((len(cells), dims), np.int64)
    sizes = np.diff(ends)
    widths = data[ends[:-1]].astype(np.int64)
    for size, w in np.unique(np.stack([sizes, widths]), axis=1).T.tolist():
        own = np.flatnonzero((sizes == size) & (widths == w))
        body = np.ascontiguousarray(data[ends[own][:, None] + np.arange(1, size)])
        out[own, : (size - 1) // w] = body.view(f"<i{w}").reshape(len(own), -1) if size > 1 else 0
    return out


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """x as the sum of digits[k] << (20 k), as doubles; only the last one has a sign."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << DIGIT:
        out.append((x & ((1 << DIGIT) - 1)).astype(np.float64))
        x = x >> DIGIT
    return [*out, x.astype(np.float64)]


class Scatter:
    """n, sums and cross-products of integer vectors, without rounding."""

    def __init__(self, dims: int) -> None:
        self.dims, self.n = dims, 0
        self.sums = np.zeros(dims, object)
        self.products = np.zeros((dims, dims), object)
        self._by_weight: dict[int, np.ndarray] = {}
        self._held = 0

    def add(self, x: np.ndarray) -> None:
        for k in range(0, len(x), BLOCK):
            block = x[k : k + BLOCK]
            digits = _digits(block)
            for a, left in enumerate(digits):
                self.sums += left.sum(axis=0).astype(np.int64).astype(object) << (DIGIT * a)
                for b, right in enumerate(digits):
                    held = self._by_weight.setdefault(a + b, np.zeros((self.dims, self.dims), np.int64))
                    held += (left.T @ right).astype(np.int64)
            self.n += len(block)
            self._held += 1
            if self._held == HELD:
                self.flush()

    def flush(self) -> None:
        for weight, held in self._by_weight.items():
            self.products += held.astype(object) << (DIGIT * weight)
        self._by_weight, self._held = {}, 0


def limbs_of(values: list[int]) -> list[list[int]]:
    """Columns of 32-bit limbs, of which only the last has a sign; sums of limbs give the limbs of sums."""
    low = (1 << 32) - 1
    return [[v >> 32 * k & low for v in values] for k in range(LIMBS - 1)] + [[v >> 32 * (LIMBS - 1) for v in values]]


def of_limbs(limbs: list[int]) -> int:
    return sum(v << 32 * k for k, v in enumerate(limbs))


def scatter(xs: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, XᵀX) of a table of packed vectors: a row an entry and task, summed by Spark."""
    names = [f"l{k}" for k in range(LIMBS)]
    schema = "i int, j int, " + ", ".join(f"{c} long" for c in names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scatter(dims)
        for batch in batches:
            own.add(unpacked(batch.column(0), dims))
        own.flush()
        if own.n:
            i, j = np.triu_indices(dims)
            values = [own.n, *own.sums.tolist(), *own.products[i, j].tolist()]
            at = [np.concatenate([[-1], np.full(dims, -1), i]), np.concatenate([[-1], np.arange(dims), j])]
            out = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((c, pa.int64()) for c in names)])
            yield batch_of(out, *(a.astype(np.int32) for a in at), *limbs_of(values))

    rows = xs.select("x").mapInArrow(partial, schema).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).collect()
    n, sums, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
    for r in rows:
        v = of_limbs([r[c] for c in names])
        if r["i"] >= 0:
            products[r["i"]][r["j"]] = products[r["j"]][r["i"]] = v
        elif r["j"] >= 0:
            sums[r["j"]] = v
        else:
            n = v
    return n, sums, products


def decomposed(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Model:
    """Components by falling eigenvalue of V = (n·XᵀX − SSᵀ) / n², each with its largest entry positive."""
    dims = len(sums)
    exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    v = np.array([[x / (n * n) for x in row] for row in exact]).reshape(dims, dims)  # correctly rounded quotients of integers
    values, vectors = np.linalg.eigh(v)
    keep = np.argsort(-values, kind="stable")[:components]
    e, w = np.maximum(values[keep], 0.0), vectors[:, keep].T
    w = w * np.where(np.take_along_axis(w, np.abs(w).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0) if dims else w
    trace = sum(exact[i][i] for i in range(dims)) / (n * n)
    return Model(n, sums, w, e, [float(x / trace) if trace else 0.0 for x in e])


def _centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n·x − S, exact: 64-bit integers where they hold it, else Python integers."""
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    wide = model.n * most + max(map(abs, model.sums), default=0)
    kind = np.int64 if wide * wide * max(1, len(model.sums)) < 2**63 else object
    return x.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def _projected(centred: np.ndarray, model: Model) -> np.ndarray:
    """The whitened vectors; NaN in components without a variance."""
    real = model.real
    root = np.where(real, np.sqrt(np.where(real, model.eigenvalues, 1.0)), np.nan)
    return (centred.astype(np.float64) / model.n) @ model.directions.T / root


def fit(xs: DataFrame, components: int = COMPONENTS) -> Model:
    """Learns from the distinct vectors of a table of packed(): their integer scatter, its components, and how far the
    covariance of what they become is from the identity (over components that have a variance)."""
    distinct = written(xs.groupBy("x").agg(F.max("dims").alias("dims")))
    dims = distinct.agg(F.max("dims")).first()[0]
    if dims is None:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), [])
    n, sums, products = scatter(distinct, dims)
    model = decomposed(n, sums, products, components)
    i, j = np.triu_indices(len(model.eigenvalues))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            w = _projected(_centred(unpacked(batch.column(0), dims), model), model)
            one = np.concatenate([w.sum(axis=0), (w.T @ w)[i, j]])
            total = one if total is None else total + one
        if total is not None:
            out = pa.schema([("at", pa.int32()), ("total", pa.float64())])
            yield batch_of(out, np.arange(len(total), dtype=np.int32), total)

    if dims:
        got = {r["at"]: r["total"] / n for r in distinct.select("x").mapInArrow(partial, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()}
        size = len(model.eigenvalues)
        gap = [abs(got[size + k] - got[a] * got[b] - (a == b)) for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if model.real[a] and model.real[b]]
        model.identity_error = max(gap, default=0.0)
    return model


def whiten(xs: DataFrame, model: Model) -> DataFrame:
    """A row per packed vector: vec_id, deviation decimal(38, 0) (the sum over dimensions of (n x − S)², null from 10^38
    on), whitened array<double> (null where a component has no variance)."""
    schema = T.StructType([xs.schema["vec_id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    size, dims = len(model.eigenvalues), len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = _centred(unpacked(batch.column(1), dims), model)
            far = (centred * centred).sum(axis=1) if dims else np.zeros(len(centred), np.int64)
            big = pa.array(far) if far.dtype == np.int64 else pa.array([v if v < 10**38 else None for v in far.tolist()], type=pa.decimal128(38, 0))
            w = _projected(centred, model)
            flat = pa.array(w.reshape(-1), mask=np.isnan(w).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * size), flat)
            out = pa.schema([batch.schema.field(0), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), big.cast(pa.decimal128(38, 0)), lists], schema=out)

    return xs.select("vec_id", "x").mapInArrow(project, schema)


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> tuple[DataFrame, Model]:
    """(rows of whiten(), the model). The offset is the shift that is subtracted again, so it changes no result; it is here
    for those who need the mean of x, (S + n * offset) / n.

    Vectors that are null or hold null or non-finite entries are dropped. Of repeated vectors one is learned from, and each
    row gets a result; ids may be null or repeated. A vector that is shorter than the longest counts as having zeros
    behind, an empty one is all zeros. Entries above 2^62 / scale count as that. Components are numbered by falling
    variance, at most one a dimension; equal variances may mix. Where there are fewer distinct vectors than dimensions,
    components without a variance stay null. An empty table gives no rows; columns besides the two named are ignored."""
    xs = written(packed(vectors, id_col, vector_col, scale))
    model = fit(xs, components)
    return whiten(xs, model), model
