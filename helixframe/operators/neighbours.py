"""Approximate nearest neighbours by descent along a neighbour graph, and one entry to all ways of finding neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graphs import _FOUND, BLOCK, _closest, _found, approximate_neighbours, matrix, nearest_neighbours
from helixframe.session import forget, sweep, tables, written

#: Vectors of a block in which the start is searched, about, and the number of ways in which blocks are cut. Products inside
#: blocks are cheap beside a round, which moves a vector to each of its neighbours, so a good start saves rounds.
START_ROWS, STARTS = 8_192, 6
#: Proposals that a member of a local join keeps.
KEEP = 12
#: Bytes of members that are shuffled with their vectors at once, about. A round of more takes its local joins in slices, one
#: after the other, so that the disk it needs does not grow with the table times the members of a join.
SLICE_BYTES = 1 << 31


def _kind(points: DataFrame) -> str:
    return f"embedding {points.schema['embedding'].dataType.simpleString()}"


def _start(points: DataFrame, width: int, n: int, dims: int, seed: int) -> DataFrame:
    """(id, neighbour, distance): the nearest in blocks of like vectors. A block is cut by the sides of random planes
    through the middle of a sample, in STARTS ways (a single block needs one); a block that comes out too large is dealt to several."""
    rng = np.random.default_rng(seed)
    bits = max(0, int(np.ceil(np.log2(max(1, n / START_ROWS)))))
    ways = STARTS if bits else 1
    planes = rng.normal(size=(ways, bits, dims))
    sample = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2_000).select("embedding").collect()
    x = np.array([r[0] for r in sample], np.float64)
    middle = np.median(np.einsum("tbd,nd->tbn", planes, x), axis=2)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            for t in range(ways):
                code = ((v @ planes[t].T > middle[t]) << np.arange(bits)).sum(axis=1) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.astype(np.int64) * ways + t)], names=["id", "embedding", "block"])

    coded = written(points.select("id", "embedding").mapInArrow(sides, f"id long, {_kind(points)}, block long"))
    sizes = coded.groupBy("block").agg(F.floor(F.count("*") / F.lit(min(BLOCK, 8 * START_ROWS)) + 1).cast("long").alias("parts"))
    dealt = coded.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")))

    def best(table: pa.Table) -> pa.Table:
        v, ids = matrix(table.column("embedding")), table.column("id").to_numpy()
        return _found(*_closest(v, ids, v, ids, width))

    return dealt.groupBy("block", "part").applyInArrow(best, _FOUND)


_LISTS = "near array<long>, far array<double>, new array<boolean>"


def _merged(rows: DataFrame, width: int) -> DataFrame:
    """State (id, embedding, near, far, new) from rows that also have proposals (to, at): the `width` nearest of both."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(name)  # noqa: E731, B023
            flat = lambda name, kind: get(name).flatten().to_numpy(zero_copy_only=False).astype(kind)
            count = lambda name: get(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            owner = np.concatenate([np.repeat(np.arange(batch.num_rows), count(c)) for c in ("near", "to")])
            other = np.concatenate([flat("near", np.int64), flat("to", np.int64)])
            far = np.concatenate([flat("far", np.float64), flat("at", np.float64)])
            new = np.arange(len(other)) >= len(get("near").flatten())
            order = np.lexsort((far, new, other, owner))  # of repeats the known one stays
            owner, other, far, new = owner[order], other[order], far[order], new[order]
            once = np.ones(len(owner), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
            owner, other, far, new = owner[once], other[once], far[once], new[once]
            order = np.lexsort((other, far, owner))
            owner, other, far, new = owner[order], other[order], far[order], new[order]
            keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < width
            ends = pa.array(np.searchsorted(owner[keep], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[keep])) for x in (other, far, new)]
            yield pa.RecordBatch.from_arrays([get("id"), get("embedding"), *lists], names=["id", "embedding", "near", "far", "new"])

    return rows.select("id", "embedding", "near", "far", "to", "at").mapInArrow(merge, f"id long, {_kind(rows)}, {_LISTS}")


def _proposed(joined: DataFrame, keep: int) -> DataFrame:
    """(id, to, at) of rows (members: id, new, worst, embedding): pairs of members of which one is new, closer than what
    one of the two has now; each member keeps its best."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            ends = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            flat = members.flatten()
            ids, new, worst, vectors = (flat.field(k) for k in range(4))
            ids, new = ids.to_numpy(zero_copy_only=False), new.to_numpy(zero_copy_only=False).astype(bool)
            worst = worst.to_numpy(zero_copy_only=False)
            v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            square = (v * v).sum(axis=1)
            out = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if z - a < 2 or not new[a:z].any():
                    continue
                d = square[a:z, None] + square[a:z] - 2 * v[a:z] @ v[a:z].T
                d = np.sqrt(np.maximum(d, 0))
                d[~(new[a:z, None] | new[a:z])] = np.inf
                np.fill_diagonal(d, np.inf)
                d[d >= worst[a:z, None]] = np.inf
                if z - a > keep:
                    col = np.argpartition(d, keep, axis=1)[:, :keep]
                    d = np.take_along_axis(d, col, axis=1)
                else:
                    col = np.broadcast_to(np.arange(z - a), d.shape)
                row, place = np.nonzero(np.isfinite(d))
                out.append((ids[a:z][row], ids[a:z][col[row, place]], d[row, place]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "to", "at"])

    return joined.select("members").mapInArrow(join, "id long, to long, at double")


#: Vectors whose neighbours are searched exactly to measure the recall of the others.
MEASURED = 500


def measured_recall(vectors: DataFrame, found: DataFrame, k: int, seed: int = 42) -> float:
    """Mean recall of `found` (id, neighbour) over MEASURED vectors that a hash draws, searched exactly."""
    asked = written(vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(MEASURED))
    exact = written(nearest_neighbours(vectors, k, queries=asked))
    # Their exact neighbours are at most MEASURED * k rows; what was found for others takes no part.
    hits = exact.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count()
    return hits / max(1, exact.count())


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"to": F.coalesce("to", F.array().cast("array<long>")), "at": F.coalesce("at", F.array().cast("array<double>"))})


def _round(state: DataFrame, width: int, sample: int, turn: int, seed: int, vector_bytes: int) -> DataFrame:
    """The next state: local joins at every vector, and what they propose merged."""
    mine = state.select("id", F.posexplode("near").alias("place", "other"), "new").select("id", "other", F.get("new", "place").alias("new"))
    both = mine.unionByName(mine.select(F.col("other").alias("id"), F.col("id").alias("other"), "new"))
    both = both.groupBy("id", "other").agg(F.max("new").alias("new"))
    drawn = Window.partitionBy("id", "new").orderBy(F.xxhash64("id", "other", F.lit(seed + turn)), "other")
    both = written(both.withColumn("place", F.row_number().over(drawn)).filter(F.col("place") <= sample).drop("place"))
    slices = -(-both.count() * (vector_bytes + 64) // SLICE_BYTES) or 1
    worst = F.when(F.size("far") < width, F.lit(float("inf"))).otherwise(F.element_at("far", -1))
    known = state.select(F.col("id").alias("other"), worst.alias("worst"), "embedding")
    nearer = Window.partitionBy("id").orderBy("at", "to")
    best = None
    for i in range(slices):
        members = both if slices == 1 else both.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)
        joined = members.join(known, "other").groupBy("id").agg(F.collect_list(F.struct("other", "new", "worst", "embedding")).alias("members"))
        found = _proposed(joined, KEEP)
        found = (found if best is None else found.unionByName(best)).groupBy("id", "to").agg(F.min("at").alias("at"))
        found = found.withColumn("place", F.row_number().over(nearer)).filter(F.col("place") <= width).drop("place")
        if slices > 1:
            found, last = written(found), best
            if last is not None:
                forget(last)
        best = found
    proposals = best.groupBy("id").agg(F.collect_list("to").alias("to"), F.collect_list("at").alias("at"))
    return _merged(_filled(state.join(proposals, "id", "left")), width)


def descended_neighbours(vectors: DataFrame, k: int, width: int | None = None, sample: int | None = None, rounds: int = 12, tolerance: float = 0.005, recall: float = 0.93, widenings: int = 3, metric: str = "euclidean", seed: int = 42) -> DataFrame:
    """(id, neighbour, distance, rank) by NN-descent: neighbours of neighbours are likely neighbours.

    Every vector keeps its `width` nearest so far (by default 3 k, 30 at least), found at first in blocks of like vectors.
    A round joins, at every vector, the neighbours in both directions: those that are new since the last round with one
    another and with the old ones, at most `sample` of either kind (by default twice the width; of a hub's many reverse
    neighbours a hash draws them). Only these members travel with their vectors, so a round's shuffle is in proportion to
    the table, and in slices of SLICE_BYTES whose files are deleted when a slice is done; distances are matrix products inside tasks. Rounds end when fewer than `tolerance` of all entries changed.
    Then the recall is measured on a few exact searches, and where it is below `recall`, the width is doubled and the rounds
    go on, `widenings` times at most: tables of many vectors in many dimensions need more than small ones. Vectors that are
    null are left out."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"no metric {metric}")
    before = tables()
    width = width or max(3 * k, 30)
    sample = sample or 2 * width
    # Single precision travels as such and is measured in doubles.
    kind = "array<float>" if metric == "euclidean" and vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    points = vectors.filter("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("embedding"))
    if metric == "cosine":
        norm = F.greatest(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-300))
        points = points.withColumn("embedding", F.transform("embedding", lambda x: x / norm))
    points = written(points)
    spark = points.sparkSession
    size = points.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    n, dims = size["n"], size["dims"]
    if not n:
        return spark.createDataFrame([], "id long, neighbour long, distance double, rank int")
    start = _start(points, width, n, dims, seed).groupBy("id").agg(F.collect_list("neighbour").alias("to"), F.collect_list("distance").alias("at"))
    nothing = {"near": F.array().cast("array<long>"), "far": F.array().cast("array<double>")}
    state, turn = written(_merged(_filled(points.withColumns(nothing).join(start, "id", "left")), width)), 0
    for widened in range(widenings + 1):
        for _ in range(rounds):
            state, turn = written(_round(state, width, sample, turn, seed, dims * (4 if kind == "array<float>" else 8))), turn + 1
            sweep(spark, before, points, state)
            if state.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] <= tolerance * n * width:
                break
        distance = F.get("far", "place")
        found = state.select("id", F.posexplode(F.slice("near", 1, k)).alias("place", "neighbour"), "far")
        found = found.select("id", "neighbour", (distance * distance / 2 if metric == "cosine" else distance).alias("distance"), (F.col("place") + 1).alias("rank"))
        if widened == widenings or n <= width + 1 or measured_recall(points, found, k, seed) >= recall:
            return found
        width, sample = 2 * width, 2 * sample
        state = state.withColumn("new", F.transform("new", lambda x: F.lit(True)))


#: Tables of up to so many vectors are searched exactly by default: beyond, the work of pairs outgrows the rounds.
EXACT_ROWS = 4 * BLOCK


def neighbours(vectors: DataFrame, k: int, method: str = "auto", metric: str = "euclidean", **more) -> DataFrame:
    """(id, neighbour, distance, rank) by one of the ways: "exact", "descent", "lists" (an inverted file, euclidean only) or
    "auto", which is exact up to EXACT_ROWS vectors and descends beyond. Further arguments go to the way chosen."""
    if method == "auto":
        method = "exact" if vectors.count() <= EXACT_ROWS else "descent"
    if method == "lists" and metric == "euclidean":
        return approximate_neighbours(vectors, k, **more)
    if method == "exact":
        return nearest_neighbours(vectors, k, metric=metric, **more)
    if method == "descent":
        return descended_neighbours(vectors, k, metric=metric, **more)
    raise ValueError(f"no way {method} with the metric {metric}")
