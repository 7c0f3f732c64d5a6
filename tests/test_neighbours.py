"""Approximate neighbours: recall of the queries with their defaults, ways and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import graphs, neighbours
from helixframe.plans import registry
from helixframe.plans.graphs import knn


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["descended_neighbours", "approximate_neighbours"])
def test_recall_of_the_queries(spark, name, sf):
    at = f"/root/testdata/{sf}"
    exact, found = knn(spark, at), registry.queries()[name](spark, at).cache()
    assert found.count() == exact.count() == found.select("id", "neighbour").distinct().count()
    assert graphs.neighbour_recall(exact, found).agg(F.avg("recall")).first()[0] >= 0.9


def test_descent_from_a_poor_start(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "START_ROWS", 12)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    v = vectors(spark, x)
    exact = graphs.nearest_neighbours(v, 5)
    first = neighbours.descended_neighbours(v, 5, width=6, rounds=1, widenings=0)
    low = graphs.neighbour_recall(exact, first).agg(F.avg("recall")).first()[0]
    found = neighbours.descended_neighbours(v, 5, width=6)  # widens, as its recall is measured
    high = graphs.neighbour_recall(exact, found).agg(F.avg("recall")).first()[0]
    assert low < 0.9 <= high
    for r in found.limit(200).collect():
        assert r["distance"] == pytest.approx(np.linalg.norm(x[r["id"]] - x[r["neighbour"]]), abs=1e-6)


def test_descent_starts_well(spark, monkeypatch):
    """One block is searched exactly; several, cut in STARTS ways, find most neighbours."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4_000, 16)).astype(np.float32)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, embedding array<float>")
    exact = graphs.nearest_neighbours(v, 5).cache()
    recall = lambda found: graphs.neighbour_recall(exact, found).agg(F.avg("recall")).first()[0]
    start = lambda: graphs._ranked(neighbours._start(v, 5, 4_000, 16, 1).distinct(), 5)
    assert recall(start()) == 1  # one block
    monkeypatch.setattr(neighbours, "START_ROWS", 512)
    assert recall(start()) > 0.6
    found = neighbours.descended_neighbours(v, 5)
    doubles = neighbours.descended_neighbours(v.select("id", F.col("embedding").cast("array<double>").alias("embedding")), 5)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(found) == key(doubles)  # single precision travels, doubles are measured
    assert recall(found) > 0.9


def test_small_and_odd_tables(spark):
    rng = np.random.default_rng(4)
    v = vectors(spark, np.repeat(rng.normal(size=(4, 3)), 3, axis=0))  # equal vectors, fewer than the width
    rows = v.unionByName(spark.createDataFrame([(99, None)], v.schema))
    found = neighbours.descended_neighbours(rows, 5)
    exact = graphs.nearest_neighbours(v, 5)
    key = lambda df: sorted((r["id"], r["rank"], round(r["distance"], 6)) for r in df.collect())
    assert key(found) == key(exact)
    cosine = neighbours.neighbours(v, 5, "descent", "cosine")
    assert np.allclose([x[2] for x in key(cosine)], [x[2] for x in key(graphs.nearest_neighbours(v, 5, metric="cosine"))], atol=1e-6)
    assert neighbours.descended_neighbours(v.limit(0), 5).count() == 0
    assert key(neighbours.neighbours(v, 5)) == key(exact)
    with pytest.raises(ValueError):
        neighbours.neighbours(v, 5, "lists", "cosine")


def test_vectors_travel_in_proportion():
    """Copies of a vector that are shuffled, for the exact search of a table in itself on 12 cores: 148 before at 600,000."""
    copies = lambda n, dims: sum(graphs.tiled(n, n, dims, 12))
    assert copies(600_000, 64) <= 24 and copies(100_000, 64) <= 32
    assert graphs.tiled(600_000, 500, 64, 12)[1] == 1  # a few queries travel, not the table
    assert graphs.tiled(10, 0, 64, 12)[0] == 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e17])
def test_closest_is_exact_with_ties(metric, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3_000, 6)) * scale
    x[rng.integers(0, 3_000, 300)] = x[7]
    ids, asked = rng.permutation(3_000) * 2, 40
    own, near, _ = graphs._closest(x, ids, x[:asked], ids[:asked], 9, metric)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u[:asked] @ u.T if metric == "cosine" else np.sqrt(((x[:asked, None] - x) ** 2).sum(axis=2))
    d[ids[:asked, None] == ids] = np.inf
    for i in range(asked):
        best = np.sort(ids[np.lexsort((ids, np.round(d[i], 9)))[:9]])
        assert np.array_equal(np.sort(near[own == ids[i]]), best)


def test_lists_are_dealt_to_blocks(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(900, 5)), np.full((300, 5), 9.0) + rng.normal(size=(300, 5)) * 1e-3])  # one list outgrows a block
    v = vectors(spark, x)
    centres = np.array([[0.0] * 5, [9.0] * 5, [4.0] * 5])
    _, sizes = graphs._listed(v, centres)
    dealt = graphs._blocks_of_lists(sizes, centres, 8)
    assert sum(sizes.values()) == 1_200 and {each for each, _, _ in dealt} == set(sizes) and max(pieces for _, _, pieces in dealt) > 1
    key = lambda df: sorted((r["id"], r["rank"], r["neighbour"]) for r in df.collect())
    assert key(graphs._of_lists(v, 6, None, centres, 3)) == key(graphs.nearest_neighbours(v, 6))


def test_lists_of_a_block_hold_few_neighbours():
    """What a task of the inverted file holds does not grow with the lists that its queries visit."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists, each, asked, k = 300, 12, 1_500, 10
    x = rng.normal(size=(lists * each + asked, 4)).astype(np.float32)
    at = [[i // each] for i in range(lists * each)] + [list(range(lists))] * asked
    table = pa.table({"id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float32())), "q": pa.array(np.arange(len(x)) >= lists * each), "at": pa.array(at, pa.list_(pa.int32()))})
    tracemalloc.start()
    got = graphs._of_block(table, k).to_pandas()
    assert tracemalloc.get_traced_memory()[1] < 150_000_000  # all 4.5 million neighbours of lists take 108 MB before they are sorted
    tracemalloc.stop()
    d = ((x[lists * each :, None].astype(np.float64) - x[None, : lists * each]) ** 2).sum(axis=2)
    near = np.argsort(d, axis=1)[:, :k]
    assert (np.sort(got["neighbour"].to_numpy().reshape(asked, k), axis=1) == np.sort(near, axis=1)).all()


def test_rounds_in_slices(spark, monkeypatch):
    """A round in slices gives the same rows as one at once, and leaves neither files of shuffles nor proposals of slices."""
    from pathlib import Path

    from helixframe import session

    v = session.written(vectors(spark, np.random.default_rng(6).normal(size=(600, 6))))
    monkeypatch.setattr(neighbours, "START_ROWS", 64)
    start = neighbours._start(v, 5, 600, 6, 1).groupBy("id").agg(F.collect_list("neighbour").alias("to"), F.collect_list("distance").alias("at"))
    nothing = {"near": F.array().cast("array<long>"), "far": F.array().cast("array<double>")}
    state = session.written(neighbours._merged(neighbours._filled(v.withColumns(nothing).join(start, "id", "left")), 5))
    rows = lambda: sorted((r["id"], r["near"], r["far"]) for r in neighbours._round(state, 5, 10, 0, 1, 48).collect())
    whole, local = rows(), Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    held, made = set(local.rglob("shuffle_*.data")), session.tables()
    monkeypatch.setattr(neighbours, "SLICE_BYTES", 100_000)
    out = neighbours._round(state, 5, 10, 0, 1, 48)
    assert not set(local.rglob("shuffle_*.data")) - held and len(session.tables() - made) == 2
    assert sorted((r["id"], r["near"], r["far"]) for r in out.collect()) == whole
    monkeypatch.undo()
