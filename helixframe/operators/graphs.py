"""Graphs as edges (src, dst, weight): diffusion, label propagation, nearest neighbours and what is counted on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranges import positions, tile
from helixframe.session import cut, written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def shares(edges: DataFrame, by: str) -> DataFrame:
    """Weights over their sum at the node `by`. Only sums meet, so a hub's edges stay where they are."""
    total = edges.groupBy(by).agg(F.sum("weight").alias("all__"))
    return edges.join(total, by).withColumn("weight", F.col("weight") / F.col("all__")).drop("all__")


#: Rounds of a diffusion between two cuts of its lineage.
CHAIN = 4


def personalised_page_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8, sinks: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, score) of seeds (by..., node, score), normalised to sum 1; every value of the columns `by` is a
    diffusion of its own, all of them sharing the rounds. Mass of nodes without ways out returns to the seeds; out of
    sink nodes nothing flows. A round is one join and one aggregate on the node.

    Rounds add the flow of one more step. What steps to come would add is extrapolated from the last two steps, as flow
    shrinks by the damping from step to step once it is spread (two steps, as it may go back and forth between two sides);
    rounds end when CHAIN of them change the extrapolated scores by less than `tolerance` of their sum. Mass that returns
    to the seeds only scales the result, which normalising does as well."""
    keys = [*by, "node"]
    total = seeds.groupBy(*by).agg(F.sum("score").alias("t__"))
    p = seeds.groupBy(*keys).agg(F.sum("score").alias("s__"))
    p = (p.join(total, list(by)) if by else p.crossJoin(F.broadcast(total))).withColumn("s__", F.col("s__") / F.col("t__"))
    out = edges.select("src", "dst", "weight")
    if sinks is not None:
        out = out.join(sinks.select(F.col("node").alias("src")), "src", "left_anti")
    out = cut(shares(out, "src").select("src", "dst", (damping * F.col("weight")).alias("weight")))
    zero = F.lit(0.0)
    # sum: flow so far, last and now: flow of the last two steps, seen: scores at the last check.
    state = cut(p.select(*keys, F.col("s__").alias("sum"), zero.alias("last"), F.col("s__").alias("now"), zero.alias("seen")))
    ahead = F.col("sum") + (F.col("last") + F.col("now")) * (damping**2 / (1 - damping**2))
    for i in range(rounds):
        step = F.col("now") * F.col("weight")
        moved = state.filter("now > 0").join(out, F.col("node") == F.col("src")).select(*by, F.col("dst").alias("node"), step.alias("sum"), zero.alias("last"), step.alias("now"), zero.alias("seen"))
        stay = state.select(*keys, "sum", F.col("now").alias("last"), zero.alias("now"), "seen")
        state = moved.unionByName(stay).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("sum", "last", "now", "seen")))
        if i % CHAIN == CHAIN - 1:
            state = cut(state)
            off, size = state.agg(F.sum(F.abs(ahead - F.col("seen"))), F.sum(ahead)).first()
            if (off or 0.0) <= tolerance * (size or 0.0):
                break
            state = state.withColumn("seen", ahead)
    state = state.select(*keys, ahead.alias("score"))
    mass = state.groupBy(*by).agg(F.sum("score").alias("t__"))
    every = state.join(mass, list(by)) if by else state.crossJoin(F.broadcast(mass))
    return every.select(*keys, (F.col("score") / F.col("t__")).alias("score"))


def personalisation(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(node, score) of every node (node): its weight (node, weight) over the sum of weights of nodes in the graph, 0
    without one. Weights of other nodes are ignored."""
    held = nodes.select("node").distinct().join(weights.groupBy("node").agg(F.sum("weight").alias("weight")), "node", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return held.crossJoin(F.broadcast(held.agg(F.nullif(F.sum("weight"), F.lit(0.0)).alias("t__")))).select("node", (F.col("weight") / F.col("t__")).alias("score"))


def permuted_seeds(edges: DataFrame, seeds: DataFrame, permutations: int, bins: int = 10, seed: int = 42) -> DataFrame:
    """(perm, node, score): seeds moved to other nodes of alike degree. Nodes are cut into `bins` by the rank of their
    degree; a permutation orders the nodes of a bin by a seeded hash and moves each score to the node at its place."""
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    at = written(positions(degree, "degree", "node"))
    binned = at.select("node", tile(F.col("position"), at.count(), bins).alias("bin"))
    placed = binned.select("bin", "node", F.row_number().over(Window.partitionBy("bin").orderBy("node")).alias("at"))
    held = placed.join(seeds, "node").select("bin", "at", "score")
    drawn = placed.select("bin", "node", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    key = F.md5(F.concat_ws("|", F.col("node").cast("string"), F.col("perm").cast("string"), F.lit(str(seed))))
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("perm", "bin").orderBy(key)))
    return drawn.join(held, ["bin", "at"]).select("perm", "node", "score")


def diffusion_significance(edges: DataFrame, seeds: DataFrame, permutations: int = 20, bins: int = 10, seed: int = 42) -> DataFrame:
    """(node, score, mean, sd, z): a diffusion against those from permuted_seeds(), all diffused together."""
    real = personalised_page_rank(edges, seeds)
    null = personalised_page_rank(edges, permuted_seeds(edges, seeds, permutations, bins, seed), by=("perm",))
    # Diffusions that do not reach a node count as zero there.
    g = null.groupBy("node").agg(F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("q"))
    mean = F.coalesce("s", F.lit(0.0)) / permutations
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.coalesce("q", F.lit(0.0)) - permutations * mean**2) / max(1, permutations - 1)))
    return real.join(g, "node", "left").select("node", "score", mean.alias("mean"), sd.alias("sd"), ((F.col("score") - mean) / F.nullif(sd, F.lit(0.0))).alias("z"))


def tied_diffusion(edges: DataFrame, seeds_a: DataFrame, seeds_b: DataFrame, how: str = "min", rounds: int = 100) -> DataFrame:
    """(node, score): two diffusions, combined by min, max or mean; a node that one does not reach has 0 there."""
    side = seeds_a.select(F.lit("a").alias("side"), "node", "score").unionByName(seeds_b.select(F.lit("b").alias("side"), "node", "score"))
    both = personalised_page_rank(edges, side, rounds=rounds, by=("side",))
    x, y = (F.coalesce(F.sum(F.when(F.col("side") == k, F.col("score"))), F.lit(0.0)) for k in "ab")
    return both.groupBy("node").agg({"min": F.least(x, y), "max": F.greatest(x, y), "mean": (x + y) / 2}[how].alias("score"))


def label_propagation(edges: DataFrame, labels: DataFrame, alpha: float = 0.9, rounds: int = 10) -> DataFrame:
    """(node, label, p): labels (node, label) spread over incoming edges, weights normalised per node, and are drawn back
    to the seeds by 1 - alpha. Shares of a node sum to one."""
    into = cut(shares(edges.select(F.col("src").alias("u"), F.col("dst").alias("node"), "weight"), "node"))
    seed = labels.dropna().select("node", "label", F.lit(1.0).alias("p"))
    state = seed
    for i in range(rounds):
        got = into.join(state.withColumnRenamed("node", "u"), "u").select("node", "label", (alpha * F.col("p") * F.col("weight")).alias("p"))
        mix = got.unionByName(seed.withColumn("p", F.col("p") * (1 - alpha))).groupBy("node", "label").agg(F.sum("p").alias("p"))
        state = mix.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("node")))  # a row a label
        state = cut(state) if i % 5 == 4 else state
    return state


#: Vectors of the smallest blocks into which larger tables are cut, and queries whose distances to a part of a block are
#: made at once.
BLOCK, TILE = 8_192, 1_024
#: Vectors and bytes that a block holds at most.
WIDE, WIDE_BYTES = 65_536, 1 << 26
#: Distances are made in these many parts of a block at first, each next part ending at twice the last end, up to BLOCK.
FIRST = 1_024


def _tiling(vectors: DataFrame, queries: DataFrame | None) -> tuple[int, int]:
    """(blocks, parts): into how many blocks the vectors and into how many parts the queries are cut. A vector travels once
    a part and a query once a block, so both are as few as memory allows, but enough for all tasks."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    n, asked = size["n"], size["n"] if queries is None else queries.count()
    return tiled(n, asked, size["dims"] or 1, vectors.sparkSession.sparkContext.defaultParallelism)


def tiled(n: int, asked: int, dims: int, tasks: int) -> tuple[int, int]:
    """See _tiling()."""
    most = max(BLOCK // 8, min(WIDE, WIDE_BYTES // (8 * dims)))
    blocks, parts, wanted = -(-n // most) or 1, -(-asked // most) or 1, 4 * tasks
    parts = max(parts, min(-(-asked // TILE), -(-wanted // blocks)))
    return max(blocks, min(-(-n // BLOCK), -(-wanted // parts))), parts


def nearest_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, blocks: int | None = None, metric: str = "euclidean") -> DataFrame:
    """(id, neighbour, distance, rank): exact, without the row itself; ties go to the smaller id.

    Vectors (id, embedding) are dealt to blocks of up to WIDE rows, queries to parts; each part visits each block once,
    where matrix products find the k best of every query, and k rows a block are merged. Nothing is larger than a block of
    vectors with the queries dealt to it, but the work is rows times queries: approximate_neighbours() is for tables of many
    blocks. Rows without an embedding take no part."""
    blocks, parts = (blocks, blocks) if blocks else _tiling(vectors, queries)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = vectors.filter("embedding is not null").select("id", "embedding", deal(blocks).alias("block"), every(parts).alias("part"), F.lit(False).alias("q"))
    asked = (vectors if queries is None else queries).filter("embedding is not null").select("id", "embedding", every(blocks).alias("block"), deal(parts).alias("part"), F.lit(True).alias("q"))

    def best(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").to_numpy(), matrix(table.column("embedding"))
        of = table.column("q").to_numpy().astype(bool)
        return _found(*_closest(x[~of], ids[~of], x[of], ids[of], k, metric))

    found = base.unionByName(asked).groupBy("block", "part").applyInArrow(best, _FOUND)
    return _ranked(found, k)


_FOUND = "id long, neighbour long, distance double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k first of what was found for each row in several blocks."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _found(asked: np.ndarray, near: np.ndarray, distance: np.ndarray) -> pa.Table:
    return pa.table({"id": asked.astype(np.int64), "neighbour": near.astype(np.int64), "distance": distance})


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    rows = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in chunks if len(c)]
    return np.concatenate(rows).astype(np.float64) if rows else np.zeros((0, 0))


def _closest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, asked: np.ndarray, k: int, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asked, near, distance): the k rows of `a` nearest to each row of `b`, without the row itself; equal up to rounding is
    a tie, which the smaller id wins. Rows that are not finite are near nobody.

    Products in single precision, with a bound of their error, tell who may be among the k; those few are measured in
    doubles. Parts of `a` follow in the order of ids, so a row needs to be no farther than the k-th so far."""
    fine = np.isfinite(a).all(axis=1)
    order = np.flatnonzero(fine)[np.argsort(ids[fine], kind="stable")]
    a, ids = a[order], ids[order]
    fine = np.isfinite(b).all(axis=1)
    b, asked = b[fine], asked[fine]
    none = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return asked[:0], ids[:0], np.zeros(0)
    if metric == "cosine":
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
    size_a, size_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    top = size_a.max()
    single = all(1e-10 < x < 1e15 for x in (top, size_b.max()))
    kind, unit = (np.float32, 2.0**-24) if single else (np.float64, 2.0**-53)
    small, twice = a.astype(kind), (-2 * b).astype(kind)
    square = np.zeros(len(a), kind) if metric == "cosine" else (size_a**2).astype(kind)
    slack = 1.01 * (a.shape[1] + 8) * unit * (2 * size_b * top + top**2) + 8e-9 * (size_b + top) + 1e-15
    ends = sorted({0, *(FIRST << i for i in range(20) if 2 * k <= FIRST << i < min(len(a), BLOCK)), *range(BLOCK, len(a), BLOCK), len(a)})
    out = []
    for at in range(0, len(b), TILE):
        q, own, more = b[at : at + TILE], asked[at : at + TILE], slack[at : at + TILE]
        low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
        row, col, far, limit = none, none, np.zeros(0), None
        for start, end in zip(ends[:-1], ends[1:], strict=True):
            d = twice[at : at + TILE] @ small[start:end].T
            d += square[start:end]
            for j in range((high - low).max()):  # the row itself; ids are unique as a rule
                same = np.flatnonzero((low + j < high) & (low + j >= start) & (low + j < end))
                d[same, low[same] + j - start] = np.inf
            if limit is None:
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * more if end - start > k else np.full(len(q), np.inf)
                limit = limit.astype(np.float64)
            place = np.flatnonzero(d <= np.minimum(limit, np.finfo(kind).max)[:, None].astype(kind))
            if not len(place):
                continue
            new_row, new_col = place // (end - start), place % (end - start) + start
            exact = np.concatenate([_distance(q[new_row[i : i + 65_536]], a[new_col[i : i + 65_536]], metric) for i in range(0, len(place), 65_536)])
            row, col, far = np.concatenate([row, new_row]), np.concatenate([col, new_col]), np.concatenate([far, exact])
            order = np.lexsort((col, np.round(far, 9), row))
            row, col, far = row[order], col[order], far[order]
            first = np.searchsorted(row, np.arange(len(q) + 1))
            keep = np.arange(len(row)) - first[row] < k
            full = np.flatnonzero(np.diff(first) >= k)
            last = far[first[full] + k - 1]
            limit[full] = np.minimum(limit[full], (2 * last - 2 if metric == "cosine" else last**2 - size_b[at + full] ** 2) + more[full])
            row, col, far = row[keep], col[keep], far[keep]
        out.append((own[row], ids[col], far))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    return 1 - np.einsum("nd,nd->n", x, y) if metric == "cosine" else np.sqrt(np.einsum("nd,nd->n", x - y, x - y))


def approximate_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None, lists: int | None = None, probes: int | None = None, sample: int = 20_000, recall: float = 0.93, seed: int = 42) -> DataFrame:
    """(id, neighbour, distance, rank) from an inverted file: every vector is listed under its nearest of `lists` centres
    (by default the root of the number of rows), every query visits its `probes` nearest lists.

    Only the centres, fitted on at most `sample` vectors that a seeded hash draws, meet on the driver and are broadcast;
    all vectors are indexed. Lists are dealt to blocks, a large one to several, so none outgrows a task. How many true
    neighbours are found depends on `probes`: unless it is given, it is doubled from 8 on until MEASURED vectors that a hash
    draws find `recall` of their exact neighbours, or all lists are visited."""
    vectors = vectors.filter("embedding is not null")
    lists = lists or max(1, int(vectors.count() ** 0.5))
    drawn = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(sample, max(lists * 20, 1))).select("embedding").collect()
    centres = _centres(np.array([r[0] for r in drawn], np.float64), lists, seed)
    if not drawn:
        return nearest_neighbours(vectors, k, queries)
    if probes is not None:
        return _of_lists(vectors, k, queries, centres, probes)
    asked = cut(vectors.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(MEASURED).select("id", "embedding"))
    exact = cut(nearest_neighbours(vectors, k, queries=asked).select("id", "neighbour"))
    wanted, probes = exact.count(), min(8, len(centres))
    listed, sizes = _listed(vectors, centres)
    while probes < len(centres) and _visited(listed, sizes, vectors, k, asked, centres, probes).join(F.broadcast(exact), ["id", "neighbour"], "left_semi").count() < recall * wanted:  # MEASURED * k rows
        probes = min(2 * probes, len(centres))
    if probes == len(centres):
        return nearest_neighbours(vectors, k, queries)
    return _visited(listed, sizes, vectors, k, queries, centres, probes)


#: Vectors whose neighbours are searched exactly to choose the number of lists that are visited.
MEASURED = 500
#: Neighbours of all lists that a task holds before it keeps the k nearest of each query, so that its memory does not grow with
#: the number of lists that are visited.
HELD = 1_000_000


def _of_lists(vectors: DataFrame, k: int, queries: DataFrame | None, centres: np.ndarray, probes: int) -> DataFrame:
    """The k best of the vectors listed under the `probes` centres nearest to each query."""
    listed, sizes = _listed(vectors, centres)
    return _visited(listed, sizes, vectors, k, queries, centres, probes)


def _lists_of(rows: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """(id, embedding, at): the `width` centres nearest to each row, nearest first."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            for b in (batch.slice(i, TILE) for i in range(0, batch.num_rows, TILE)):
                d = (c * c).sum(1) - 2 * matrix(b.column("embedding")) @ c.T
                at = np.argsort(d, axis=1, kind="stable")[:, :width].astype(np.int32)
                ends = pa.array(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.ListArray.from_arrays(ends, pa.array(at.ravel()))], names=["id", "embedding", "at"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.filter("embedding is not null").select("id", "embedding").mapInArrow(run, f"id long, embedding {kind}, at array<int>")


def _listed(vectors: DataFrame, centres: np.ndarray) -> tuple[DataFrame, dict[int, int]]:
    """((id, embedding, list), written once, and the number of vectors of each list): each under its nearest centre."""
    listed = written(_lists_of(vectors, centres, 1).select("id", "embedding", F.col("at")[0].alias("list")))
    return listed, {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list


def _blocks_of_lists(sizes: dict[int, int], centres: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """(list, first block, its number of blocks): lists whose centres follow one another along their main direction share a
    block; one that is larger than a block has several to itself."""
    middle = centres - centres.mean(axis=0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    most = max(1, -(-sum(sizes.values()) // blocks))
    dealt, block, held = [], 0, 0
    for each in sorted(sizes, key=lambda x: (along[x], x)):
        if held and held + sizes[each] > most:
            block, held = block + 1, 0
        pieces = -(-sizes[each] // most)
        dealt.append((int(each), block, pieces))
        block, held = (block, held + sizes[each]) if pieces == 1 else (block + pieces, 0)
    return dealt


def _visited(listed: DataFrame, sizes: dict[int, int], vectors: DataFrame, k: int, queries: DataFrame | None, centres: np.ndarray, probes: int) -> DataFrame:
    """See _of_lists(). Lists are dealt to blocks; a query travels once to each block that holds lists it visits, with the
    numbers of these lists, so queries travel as often as there are blocks at most, however many lists they visit."""
    spark = vectors.sparkSession
    n = sum(sizes.values())
    asked = vectors if queries is None else queries
    wanted = n if queries is None else queries.count()
    blocks, parts = tiled(n, wanted, centres.shape[1], spark.sparkContext.defaultParallelism)
    dealt = _blocks_of_lists(sizes, centres, blocks)
    where = F.broadcast(spark.createDataFrame(dealt, "list int, first int, pieces int"))
    place = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    base = listed.join(where, "list").select("id", "embedding", place, F.array("list").alias("at"), F.lit(False).alias("q")).select("*", every)
    held = spark.sparkContext.broadcast({each: list(range(first, first + pieces)) for each, first, pieces in dealt})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_of = held.value
        for batch in (b.slice(i, TILE) for b in batches for i in range(0, b.num_rows, TILE)):
            rows, of, lists = [], [], []
            for i, at in enumerate(batch.column("at").to_pylist()):
                mine: dict[int, list[int]] = {}
                for each in at:
                    for block in blocks_of.get(each, ()):
                        mine.setdefault(block, []).append(each)
                rows += [i] * len(mine)
                of += mine.keys()
                lists += mine.values()
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("embedding").take(taken), pa.array(of, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "embedding", "block", "at"])

    kind = asked.schema["embedding"].dataType.simpleString()
    sent = _lists_of(asked, centres, min(probes, len(centres))).mapInArrow(split, f"id long, embedding {kind}, block int, at array<int>")
    sent = sent.select("id", "embedding", "block", "at", F.lit(True).alias("q"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))

    def best(table: pa.Table) -> pa.Table:
        return _of_block(table, k)

    found = base.select("id", "embedding", "block", "at", "q", "part").unionByName(sent).groupBy("block", "part").applyInArrow(best, _FOUND)
    return _ranked(found, k)


def _of_block(table: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query (q) of a block among the vectors of the lists (at) that it visits there."""
    ids, x = table.column("id").to_numpy(), matrix(table.column("embedding"))
    of = table.column("q").to_numpy().astype(bool)
    at = table.column("at").combine_chunks()
    number, owner = at.flatten().to_numpy(), np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    by = np.argsort(number, kind="stable")
    number, owner = number[by], owner[by]
    own, out, held = ~of[owner], [], 0
    most = max(HELD, 2 * k * int(of.sum()))
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        mine, base_row = owner[start:end], own[start:end]
        v, asking = mine[base_row], mine[~base_row]
        if len(v) and len(asking):
            out.append(_closest(x[v], ids[v], x[asking], ids[asking], k))
            held += len(out[-1][0])
        if held > most:
            out = [_first(out, k)]
            held = len(out[0][0])
    return _found(*_first(out, k)) if out else _found(ids[:0], ids[:0], np.zeros(0))


def _first(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of what was found for each row in several lists."""
    asking, near, far = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((near, np.round(far, 9), asking))
    asking, near, far = asking[order], near[order], far[order]
    keep = np.arange(len(asking)) - np.searchsorted(asking, asking) < k
    return asking[keep], near[keep], far[keep]


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of a small sample; empty clusters keep their centre."""
    if len(x) <= k:
        return x
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def neighbour_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(id, recall, distance_ratio): share of a row's exact neighbours that were found, and the mean distance of the found
    ones over that of the exact ones (null where that is 0). Rows of which nothing was found have recall 0."""
    k = exact.groupBy("id").agg(F.count("*").alias("k"), F.avg("distance").alias("d0"))
    hit = exact.select("id", "neighbour").join(found.select("id", "neighbour"), ["id", "neighbour"]).groupBy("id").agg(F.count("*").alias("hit"))
    far = found.groupBy("id").agg(F.avg("distance").alias("d1"))
    j = k.join(hit, "id", "left").join(far, "id", "left")
    return j.select("id", (F.coalesce("hit", F.lit(0)) / F.col("k")).alias("recall"), (F.col("d1") / F.nullif("d0", F.lit(0.0))).alias("distance_ratio"))


def shared_neighbours(knn: DataFrame, min_weight: float = 1 / 15) -> DataFrame:
    """(src, dst, shared, weight) for src < dst: Jaccard overlap of the neighbourhoods (id, neighbour), each with itself."""
    own = knn.select("id", F.explode(F.array("id", "neighbour")).alias("neighbour")).distinct()
    n = own.groupBy("id").agg(F.count("*").alias("n"))
    a, b = own.select("neighbour", F.col("id").alias("src")), own.select("neighbour", F.col("id").alias("dst"))
    s = a.join(b, "neighbour").filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))
    j = s.join(n.select(F.col("id").alias("src"), F.col("n").alias("n1")), "src").join(n.select(F.col("id").alias("dst"), F.col("n").alias("n2")), "dst")
    either = F.nullif(F.col("n1") + F.col("n2") - F.col("shared"), F.lit(0))
    return j.select("src", "dst", "shared", (F.col("shared") / either).alias("weight")).filter(F.col("weight") >= min_weight)


def inverse_simpson(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, lisi): effective number of labels (id, label) among the neighbours."""
    c = knn.select("id", "neighbour").join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.count("*").alias("c"))
    w = F.sum("c").over(Window.partitionBy("id"))
    return c.withColumn("p", F.col("c") / w).groupBy("id").agg((1 / F.sum(F.col("p") ** 2)).alias("lisi"))


def batch_chi_square(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, chi2, df): batch counts of a neighbourhood against those that global shares would give."""
    g = labels.groupBy("label").agg(F.count("*").alias("g")).withColumn("share", F.col("g") / F.sum("g").over(Window.partitionBy(F.lit(0))))
    c = knn.join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.count("*").alias("c"))
    n = c.groupBy("id").agg(F.sum("c").alias("k"))
    seen = c.join(F.broadcast(g), "label").join(n, "id")
    # Labels that are absent add their expected count, so only present ones need rows.
    e = F.col("k") * F.col("share")
    s = seen.groupBy("id").agg(F.sum((F.col("c") - e) ** 2 / e - e).alias("s"), F.first("k").alias("k"))
    return s.crossJoin(F.broadcast(g.agg((F.count("*") - 1).alias("df")))).select("id", (F.col("s") + F.col("k")).alias("chi2"), "df")


def cluster_connectivity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(c1, c2, n_edges, expected, connectivity) for c1 < c2: edges between clusters over those expected at random."""
    e = edges.select("src", "dst").join(labels.select(F.col("id").alias("src"), F.col("label").alias("l1")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("l2")), "dst")
    out = e.groupBy("l1").agg(F.count("*").alias("e_out"))
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = labels.agg(F.count("*").alias("n_all"))
    c = e.filter("l1 <> l2").groupBy(F.least("l1", "l2").alias("c1"), F.greatest("l1", "l2").alias("c2")).agg(F.count("*").alias("n_edges"))
    of = lambda i: size.join(out, F.col("label") == F.col("l1"), "left").select(F.col("label").alias(f"c{i}"), F.col("n").alias(f"n{i}"), F.coalesce("e_out", F.lit(0)).alias(f"e{i}"))
    j = c.join(F.broadcast(of(1)), "c1").join(F.broadcast(of(2)), "c2").crossJoin(F.broadcast(total))
    expected = (F.col("e1") * F.col("n2") + F.col("e2") * F.col("n1")) / (F.col("n_all") - 1)
    return j.select("c1", "c2", "n_edges", expected.alias("expected"), F.least(F.lit(1.0), F.col("n_edges") / expected).alias("connectivity"))


def silhouette(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, a, b, width) by squared Euclidean distance, from sums per label: the mean squared distance to a cluster is a
    closed form of its count, mean and squared norm, so no pairs are made. Lone rows have width 0."""
    v = vectors.join(labels.select("id", "label"), "id")
    x = v.select("id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = x.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("q"), F.count("*").alias("n"))
    d = x.select("id", F.col("label").alias("own"), "i", "x").join(F.broadcast(mean), "i")  # labels times dimensions
    g = d.groupBy("id", "own", "label").agg(F.sum(F.col("n") * F.col("x") ** 2 - 2 * F.col("x") * F.col("s") + F.col("q")).alias("all_d"), F.first("n").alias("n"))
    a = F.max(F.when(F.col("own") == F.col("label"), F.col("all_d") / F.nullif(F.col("n") - 1, F.lit(0))))
    b = F.min(F.when(F.col("own") != F.col("label"), F.col("all_d") / F.col("n")))
    w = g.groupBy("id").agg(a.alias("a"), b.alias("b"))
    return w.select("id", "a", "b", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("width"))


def nearest_of_all(knn: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row over all its batches: (id, neighbour, distance, rank, ...)."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "neighbour"))
    return knn.withColumn("rank", rank).filter(F.col("rank") <= k)


def batch_balanced_neighbours(vectors: DataFrame, batches: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """(id, neighbour, distance, rank, batch): the k nearest of every row within each batch."""
    from functools import reduce

    names = [r[0] for r in batches.select("label").distinct().orderBy("label").collect()]  # batches are few
    every = [nearest_neighbours(vectors.join(batches.filter(F.col("label") == b), "id", "left_semi"), k, vectors, blocks).withColumn("batch", F.lit(b)) for b in names]
    return reduce(DataFrame.unionByName, every)


def neighbourhood_counts(knn: DataFrame, index: DataFrame, samples: DataFrame) -> DataFrame:
    """(nhood, sample, n): cells of each sample among the neighbours of an index cell (id), itself included."""
    own = index.select("id")
    held = knn.join(own, "id", "left_semi").select("id", F.col("neighbour").alias("cell")).unionByName(own.select("id", F.col("id").alias("cell")))
    return held.join(samples.select(F.col("id").alias("cell"), F.col("label").alias("sample")), "cell").groupBy(F.col("id").alias("nhood"), "sample").agg(F.count("*").alias("n"))


def imputed(norm: DataFrame, edges: DataFrame, steps: int = 3) -> DataFrame:
    """(cell, gene, value): expression averaged over row-normalised edges (src, dst, weight), `steps` times."""
    t = shares(edges, "src")
    x = norm.select("cell", "gene", F.col("norm").alias("value"))
    for i in range(steps):
        x = t.join(x, F.col("dst") == F.col("cell")).groupBy(F.col("src").alias("cell"), "gene").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        x = cut(x) if i % 3 == 2 else x
    return x


def local_autocorrelation(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene, g, n): sum over edges of the product of z-scored values (cell, gene, value); zeros must be rows."""
    w = Window.partitionBy("gene")
    z = values.select("cell", "gene", ((F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))).alias("z")).filter("z is not null")
    a, b = z.select(F.col("cell").alias("src"), "gene", F.col("z").alias("z1")), z.select(F.col("cell").alias("dst"), "gene", F.col("z").alias("z2"))
    return edges.select("src", "dst", "weight").join(a, "src").join(b, ["dst", "gene"]).groupBy("gene").agg(F.sum(F.col("weight") * F.col("z1") * F.col("z2")).alias("g"), F.count("*").alias("n"))


def gram(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of embeddings: one small matrix a task, added up in a tree of two steps."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64)
            if len(x):
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            for i, row in enumerate(np.vstack((s, g))):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([n]), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["i", "n", "v"])

    rows = vectors.select("embedding").mapInArrow(part, "i long, n long, v array<double>")
    cells = rows.select("i", "n", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # dimensions squared
    d = max((c["j"] for c in cells), default=-1) + 1
    m = np.zeros((d + 1, d))
    for c in cells:
        m[c["i"], c["j"]] = c["x"]
    return (cells[0]["n"] if cells else 0), m[0], m[1:]


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """(id, pc): scores on the first k components of centred embeddings, signs so that each loading sums up positive."""
    n, s, g = gram(vectors)
    mu = s / n
    values, basis = np.linalg.eigh((g - n * np.outer(mu, mu)) / (n - 1))
    basis = basis[:, np.argsort(values)[::-1][:k]]
    basis = basis * np.where(basis.sum(0) < 0, -1.0, 1.0)
    return _projected(vectors, mu, basis)


def contrastive_components(vectors: DataFrame, background: DataFrame, alpha: float, k: int) -> DataFrame:
    """(id, pc): scores on the first eigenvectors of the covariance less alpha times that of the background."""
    (n, s, g), (m, t, h) = gram(vectors), gram(background)
    mu, nu = s / n, t / m
    values, basis = np.linalg.eigh((g - n * np.outer(mu, mu)) / (n - 1) - alpha * (h - m * np.outer(nu, nu)) / (m - 1))
    basis = basis[:, np.argsort(values)[::-1][:k]]
    return _projected(vectors, mu, basis * np.where(basis.sum(0) < 0, -1.0, 1.0))


def _projected(vectors: DataFrame, mu: np.ndarray, basis: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("embedding").to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(((x - mu) @ basis).tolist(), pa.list_(pa.float64()))], names=["id", "pc"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, pc array<double>")
