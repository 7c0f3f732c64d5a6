"""Diffusion maps by block Lanczos, and pseudotime with fates along them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import sweep, tables, written


def adaptive_kernel(knn: DataFrame) -> DataFrame:
    """(src, dst, weight), both directions: exp(-distance / width of the source) of neighbours (id, neighbour, distance,
    rank), added to that of the other direction; the width is the distance of the neighbour at a third of the ranks."""
    k = knn.groupBy("id").agg(F.max("rank").alias("k"))
    third = F.greatest(F.floor(F.col("k") / 3), F.lit(1))
    width = knn.join(k, "id").filter(F.col("rank") == third).select("id", F.greatest("distance", F.lit(1e-12)).alias("width"))
    w = knn.join(width, "id").select(F.col("id").alias("src"), F.col("neighbour").alias("dst"), F.exp(-F.col("distance") / F.col("width")).alias("weight"))
    return w.unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def products(rows: DataFrame, left: str, right: str) -> np.ndarray:
    """The matrix of sums over rows of products of entries of two array columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x, y = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in (0, 1))
            total = x.T @ y if total is None else total + x.T @ y
        if total is not None and total.size:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = rows.select(left, right).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # columns squared
    out = np.zeros((max((r["i"] for r in got), default=-1) + 1, max((r["j"] for r in got), default=-1) + 1))
    for r in got:
        out[r["i"], r["j"]] = r["v"]
    return out


def _combined(rows: DataFrame, parts: dict[str, np.ndarray], to: str, keep: list[str]) -> DataFrame:
    """Adds the array column `to`, a sum of array columns times matrices, and keeps the columns `keep`."""
    told = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + f", {to} array<double>"
    names = [*keep, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = sum(b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) @ m for c, m in parts.items())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists], names=names)

    return rows.mapInArrow(run, told)


def _times(a: DataFrame, rows: DataFrame, column: str, width: int) -> DataFrame:
    """(id, out): the matrix a (src, dst, weight) times an array column; one join and one sum."""
    j = a.join(rows.select(F.col("id").alias("dst"), F.col(column).alias("x__")), "dst")
    g = j.groupBy(F.col("src").alias("id")).agg(*(F.sum(F.col("weight") * F.col("x__")[k]).alias(f"y{k}") for k in range(width)))
    return g.select("id", F.array(*(f"y{k}" for k in range(width))).alias("out"))


def leading_vectors(a: DataFrame, components: int, block: int = 8, tolerance: float = 1e-5, most: int = 20, seed: int = 42) -> tuple[DataFrame, np.ndarray, float]:
    """((id, v array), eigenvalues, the largest residual) of a symmetric matrix (src, dst, weight) without empty rows, by
    falling eigenvalue, by block Lanczos.

    A step multiplies the newest block of vectors by the matrix, which is one join, and makes it orthogonal to all before
    it by one pass of inner products; small matrices of inner products are all that meets on the driver. What rounding
    leaves of orthogonality is accounted for when the eigenproblem of the basis is solved. Steps end when the residuals of
    the leading vectors are below `tolerance`, or after `most` steps."""
    before, spark = tables(), a.sparkSession
    a = written(a)
    ids = a.select(F.col("src").alias("id")).distinct()
    n = ids.count()
    components, block = min(components, n), min(block, n)
    start = [(F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(f"x{k}") for k in range(block)]
    x = written(ids.select("id", *start).select("id", F.array(*(f"x{k}" for k in range(block))).alias("new")))
    # q holds the blocks so far, p the matrix times them.
    root = np.linalg.cholesky(products(x, "new", "new")).T
    state = _combined(x, {"new": np.linalg.inv(root)}, "new", ["id"]).select("id", F.array().cast("array<double>").alias("q"), F.array().cast("array<double>").alias("p"), "new")
    values, vectors, worst, m = np.zeros(0), np.zeros((0, 0)), np.inf, 0
    for step in range(most):
        m += block
        full = state.join(_times(a, state, "new", block), "id").select("id", F.concat("q", "new").alias("q"), F.concat("p", "out").alias("p"), "out")
        full = written(full)
        sweep(spark, before, a, full)
        gram = products(full.select(F.concat("q", "p").alias("l"), F.concat("q", "p").alias("r")), "l", "r")
        qq, qp, pp = gram[:m, :m], gram[:m, m:], gram[m:, m:]
        inner, basis = np.linalg.eigh(qq)
        good = inner > 1e-10 * inner.max()
        basis = basis[:, good] / np.sqrt(inner[good])
        values, y = np.linalg.eigh(basis.T @ ((qp + qp.T) / 2) @ basis)
        top = np.argsort(-values)[:components]
        values, vectors = values[top], basis @ y[:, top]
        # |A v - value v|² from inner products.
        far = np.einsum("ik,ij,jk->k", vectors, pp, vectors) - 2 * values * np.einsum("ik,ij,jk->k", vectors, qp, vectors) + values**2 * np.einsum("ik,ij,jk->k", vectors, qq, vectors)
        worst = float(np.sqrt(np.maximum(far, 0)).max())
        if (len(values) == components and worst < tolerance) or step == most - 1:
            break
        # The next block: the product less its part in the basis, made orthonormal.
        last = slice(m - block, m)
        part = np.linalg.lstsq(qq, qp[:, last], rcond=None)[0]
        rest = pp[last, last] - part.T @ qp[:, last] - qp[:, last].T @ part + part.T @ qq @ part
        size, turn = np.linalg.eigh((rest + rest.T) / 2)
        keep = size > 1e-14 * max(1.0, size.max())
        if not keep.any() or m >= n:  # the basis holds all that the start can reach
            break
        scale, block = turn[:, keep] / np.sqrt(size[keep]), int(keep.sum())
        state = _combined(full, {"q": -part @ scale, "out": scale}, "new", ["id", "q", "p"])
    out = written(_combined(full, {"q": vectors}, "v", ["id"]))
    sweep(spark, before, out)
    return out, values, worst


def diffusion_map(knn: DataFrame, components: int = 10, **more) -> tuple[DataFrame, np.ndarray, float]:
    """((id, dc array), eigenvalues, residual): right eigenvectors of the random walk on adaptive_kernel(), of unit length,
    the largest entry positive where it is told apart; the first is constant and has the eigenvalue 1."""
    k = written(adaptive_kernel(written(knn.select("id", "neighbour", "distance", "rank"))))
    degree = written(k.groupBy("src").agg(F.sum("weight").alias("d")))
    a = k.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight"))
    found, values, residual = leading_vectors(a, components, **more)
    walk = written(found.join(degree.select(F.col("src").alias("id"), "d"), "id").select("id", F.transform("v", lambda x: x / F.sqrt("d")).alias("v")))
    size = walk.select(*(F.sqrt(F.sum(F.col("v")[j] ** 2)).alias(f"n{j}") for j in range(len(values))), *(F.max_by(F.col("v")[j], F.struct(F.abs(F.col("v")[j]), "id")).alias(f"s{j}") for j in range(len(values)))).first()
    scale = [(1 if size[f"s{j}"] >= 0 else -1) / size[f"n{j}"] for j in range(len(values))]
    return walk.select("id", F.array(*(F.col("v")[j] * scale[j] for j in range(len(values)))).alias("dc")), values, residual


def multiscale(dc: DataFrame, values: np.ndarray, kept: int | None = None) -> DataFrame:
    """(id, x array): components times value / (1 - value), without the constant one; `kept` counts it, and is by default
    where the largest gap between eigenvalues lies, 3 at least."""
    if kept is None:
        gaps = -np.diff(values)
        kept = max(3, int(np.argmax(gaps[2:])) + 3) if len(gaps) > 2 else len(values)
    w = [float(v / max(1 - v, 1e-9)) for v in values[1:kept]]
    return dc.select("id", F.array(*(F.col("dc")[j + 1] * x for j, x in enumerate(w))).alias("x"))


def _relaxed(edges: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """One round of shortest ways (id, d array) over edges (src, dst, length)."""
    j = edges.join(state.select(F.col("id").alias("dst"), F.col("d").alias("t")), "dst")
    near = j.groupBy(F.col("src").alias("id")).agg(*(F.min(F.col("length") + F.col("t")[k]).alias(f"y{k}") for k in range(width)))
    both = state.join(near, "id", "left")
    new = F.array(*(F.least(F.col("d")[k], F.coalesce(f"y{k}", F.lit(float("inf")))) for k in range(width)))
    return both.select("id", new.alias("d"), (new != F.col("d")).alias("moved"))


def palantir(knn: DataFrame, start: int, ends: list[int], waypoints: int = 60, components: int = 10, rounds: int = 60, refinements: int = 25, least: float = 0.01) -> tuple[DataFrame, list[int]]:
    """((id, pseudotime, entropy, fates array), way points) of neighbours (id, neighbour, distance, rank), from the cell
    `start` to the cells `ends`; fates are in their order.

    Way points lie evenly along each multiscale diffusion component; the start and the ends are among them. Shortest ways
    over the neighbour graph lead from all of them to all cells at once, a round being one join. Every way point sees the
    cells at its own time plus or less the way to them; pseudotime is the mean of these views, near way points counting
    most, repeated until it settles. Fates are absorption probabilities of a walk on the way points that does not go back,
    carried to the cells by the same weights; those below `least` are zero. Way points, a parameter, squared are what meets
    on the driver. Cells that no way reaches have null results."""
    spark, knn = knn.sparkSession, written(knn.select("id", "neighbour", "distance", "rank"))
    dc, values, _ = diffusion_map(knn, components, tolerance=1e-3, most=12)
    x = written(multiscale(dc, values))
    wide = len(x.first()["x"])
    span = x.select(*(F.min(F.col("x")[j]).alias(f"a{j}") for j in range(wide)), *(F.max(F.col("x")[j]).alias(f"z{j}") for j in range(wide))).first()
    each = max(2, waypoints // wide)
    long = x.select("id", F.posexplode("x").alias("j", "v"))
    low, high = (F.array(*(F.lit(span[f"{c}{j}"]) for j in range(wide)))[F.col("j")] for c in "az")
    at = (F.col("v") - low) / F.greatest(high - low, F.lit(1e-300)) * (each - 1)
    near = long.withColumn("bin", F.round(at)).groupBy("j", "bin").agg(F.min_by("id", F.struct(F.abs(at - F.round(at)), "id")).alias("id"))
    points = [start, *(e for e in ends if e != start)]
    points += sorted({r["id"] for r in near.collect()} - set(points))  # at most about `waypoints`
    m = len(points)
    of = lambda c, n: x.select(F.col("id").alias(c), F.col("x").alias(n))
    square = F.aggregate(F.zip_with("u", "v", lambda p, q: (p - q) ** 2), F.lit(0.0), lambda s, t: s + t)
    edges = knn.select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    edges = edges.union(edges.select("dst", "src")).distinct().join(of("src", "u"), "src").join(of("dst", "v"), "dst").select("src", "dst", F.sqrt(square).alias("length"))
    edges, before = written(edges), tables()
    state = written(x.select("id", F.array(*(F.when(F.col("id") == p, F.lit(0.0)).otherwise(F.lit(float("inf"))) for p in points)).alias("d")))
    for _ in range(rounds):
        new = written(_relaxed(edges, state, m))
        state = new.select("id", "d")
        sweep(spark, before, new)
        if not new.filter("moved").head(1):
            break
    marked = {r["id"]: np.array(r["d"]) for r in state.filter(F.col("id").isin(points)).collect()}
    way = np.stack([marked[p] for p in points])  # from a way point, to each
    finite = way[np.isfinite(way)]
    sigma = max(float(finite.std()) * 1.06 * max(1, finite.size) ** -0.2, 1e-12)

    def weights(d: np.ndarray) -> np.ndarray:
        w = np.where(np.isfinite(d), np.exp(-0.5 * (np.where(np.isfinite(d), d, 0) / sigma) ** 2), 0.0)
        none = w.sum(axis=1) == 0  # far from all: the nearest counts
        w[none] = np.where(np.isfinite(d[none]), d[none] == d[none].min(axis=1, keepdims=True), 0.0)
        return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)

    def seen(d: np.ndarray, own: np.ndarray, time: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Times of cells with ways d and times `own`, as way points at `time` see them."""
        sign = np.where(own[:, None] < time[None], -1.0, 1.0)
        return (w * np.where(np.isfinite(d), time[None] + sign * np.where(np.isfinite(d), d, 0), 0)).sum(axis=1)

    time, w = np.where(np.isfinite(way[0]), way[0], np.nanmax(np.where(np.isfinite(way[0]), way[0], np.nan))), weights(way)
    views = [time]  # the times of the way points in each refinement: cells follow from their own ways by the same steps
    for _ in range(refinements):
        new = seen(way, time, time, w)
        done = np.corrcoef(new, time)[0, 1] > 0.9999 if m > 2 else True
        time = new
        views.append(time)
        if done:
            break
    fates = _fates(way, time, [points.index(e) for e in ends], sigma)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, m)
            w, own = weights(d), d[:, 0]
            for t in views[:-1]:
                own = seen(d, own, t, w)
            f = w @ fates
            f = np.where(f < least, 0.0, f)
            p = f / np.maximum(f.sum(axis=1, keepdims=True), 1e-300)
            entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1)
            lost = ~np.isfinite(d[:, 0])
            lists = pa.array([None if x else row for x, row in zip(lost.tolist(), f.tolist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, mask=lost), pa.array(entropy, mask=lost), lists], names=["id", "time", "entropy", "fates"])

    told = written(state.mapInArrow(follow, f"id {x.schema['id'].dataType.simpleString()}, time double, entropy double, fates array<double>"))
    r = told.agg(F.min("time").alias("a"), F.max("time").alias("z")).first()
    scaled = (F.col("time") - r["a"]) / max((r["z"] or 0) - (r["a"] or 0), 1e-300) if r["z"] is not None else F.col("time")
    return told.select("id", scaled.alias("pseudotime"), "entropy", "fates"), points


def _fates(way: np.ndarray, time: np.ndarray, ends: list[int], sigma: float, near: int = 15) -> np.ndarray:
    """Absorption probabilities in `ends` of a walk between way points that goes back in time by little only."""
    m = len(way)
    walk = np.zeros((m, m))
    for i in range(m):
        order = [j for j in np.argsort(way[i], kind="stable") if j != i and np.isfinite(way[i, j])][:near]
        width = max(way[i, order[min(len(order) - 1, near // 3)]], 1e-12) if order else 1.0
        for j in order:
            if time[j] >= time[i] - 0.1 * sigma:
                walk[i, j] = np.exp(-way[i, j] / width)
        if not walk[i].any() and i not in ends and order:  # a dead end that is no end: on to the nearest end
            walk[i, min(ends, key=lambda e: way[i, e])] = 1.0
    walk[ends] = 0.0
    walk /= np.maximum(walk.sum(axis=1, keepdims=True), 1e-300)
    rest = [i for i in range(m) if i not in ends]
    out = np.zeros((m, len(ends)))
    out[ends, range(len(ends))] = 1.0
    inner = np.eye(len(rest)) - walk[np.ix_(rest, rest)]
    out[rest] = np.linalg.lstsq(inner, walk[np.ix_(rest, ends)], rcond=None)[0].clip(0, 1)
    return out
