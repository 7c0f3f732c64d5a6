"""Leiden and Louvain: planted groups, several resolutions, blocks, connected communities."""

import numpy as np
import pytest

from helixframe.operators import communities
from helixframe.session import written
from test_integration import EDGES, plain_modularity, planted


def by_resolution(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["resolution"], {})[r["node"]] = r["label"]
    return out


def pieces(edges, label):
    """Number of connected pieces of the communities, by union-find."""
    root = {v: v for v in label}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b, _ in edges:
        if label[a] == label[b]:
            root[find(a)] = find(b)
    return len({find(v) for v in label})


def test_planted_groups_at_several_resolutions(spark):
    edges = planted()
    df = spark.createDataFrame([*edges, (0, 99, 0.0), (None, 1, 1.0)], EDGES)
    got = communities.leiden(df, (0.1, 1.0, 4.0))
    found = by_resolution(got)
    truth = {i: i // 12 for i in range(48)}
    assert sorted(found) == [0.1, 1.0, 4.0]
    for label in found.values():
        assert sorted(label) == list(range(48)) and all(label[x] == x for x in label.values())
        assert pieces(edges, label) == len(set(label.values()))
    n = {r: len(set(label.values())) for r, label in found.items()}
    assert n[0.1] < n[1.0] == 4 < n[4.0]
    assert plain_modularity(edges, found[1.0]) >= plain_modularity(edges, truth) - 1e-12
    summary = {r["resolution"]: r for r in communities.resolution_summary(df, got).collect()}
    assert summary[1.0]["modularity"] == pytest.approx(plain_modularity(edges, found[1.0])) and summary[4.0]["n_communities"] == n[4.0]
    assert communities.leiden(df.limit(0)).count() == 0


def test_blocks_reach_planted_groups(spark):
    edges = planted(6, 15, seed=5)
    df = spark.createDataFrame(edges, EDGES)
    truth = {i: i // 15 for i in range(90)}
    found = by_resolution(communities.leiden(df, block_edges=200))[1.0]  # some eight blocks
    assert plain_modularity(edges, found) >= plain_modularity(edges, truth) - 0.02
    assert pieces(edges, found) == len(set(found.values()))


def test_two_cliques_and_a_bridge(spark):
    clique = lambda at: [(at + i, at + j, 1.0) for i in range(6) for j in range(i + 1, 6)]
    edges = [*clique(0), *clique(10), (5, 20, 0.5), (20, 10, 0.5), (30, 31, 2.0)]
    found = by_resolution(communities.leiden(spark.createDataFrame(edges, EDGES)))[1.0]
    assert {found[i] for i in range(6)} == {0} and len({found[10 + i] for i in range(6)}) == 1 and found[0] != found[10] and found[30] == found[31] == 30


def test_disconnected_communities_are_cut(spark):
    edges = [(0, 1, 1.0), (2, 3, 1.0), (1, 4, 1.0)]
    way = spark.createDataFrame([(1.0, a, b, w) for x in edges for a, b, w in (x, (x[1], x[0], x[2]))], "resolution double, src long, dst long, weight double")
    nodes = spark.createDataFrame([(1.0, i, 7) for i in range(4)] + [(1.0, 4, 8)], "resolution double, node long, community long")
    got = {r["node"]: r["community"] for r in communities._connected(way, nodes).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_privileged_communities(spark):
    rng = np.random.default_rng(8)
    groups = np.arange(90) // 15  # six groups, of which the first four are reached; then far nodes
    rows = [(i, j, 1.0) for i in range(90) for j in range(i + 1, 90) if groups[i] == groups[j] and rng.random() < 0.6]
    rows += [(i, i + 15, 0.05) for i in range(75)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    scores = spark.createDataFrame([(i, float(1 + (i < 60))) for i in range(90)], "node long, score double")
    seeds = spark.createDataFrame([(0,), (1,), (16,), (20,), (31,), (59,)], "node long")
    for resolution in (1.0, 1e-6):  # told apart at once, or divided again from one community
        out = communities.privileged_communities(edges, scores, seeds, share=2 / 3, resolution=resolution, max_nodes=20, min_nodes=10, min_seeds=2, step=0.5).collect()
        got = {}
        for r in out:
            got.setdefault(r["label"], set()).add(r["node"])
            assert (r["size"], r["seeds_1"]) == (15, 2)
        assert sorted(map(sorted, got.values())) == [list(range(15)), list(range(15, 30))]


def test_large_communities_are_divided_to_the_end(spark):
    """Too few raises of the resolution drop no community: raises double until all are small."""
    rows = [(8 * g + i, 8 * g + j, 1.0) for g in range(3) for i in range(8) for j in range(i + 1, 8)] + [(0, 8, 0.5), (8, 16, 0.5), (16, 0, 0.5)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    nodes = spark.range(24).select("id")
    scores, seeds = nodes.selectExpr("id as node", "1.0D as score"), nodes.selectExpr("id as node")
    out = communities.privileged_communities(edges, scores, seeds, share=1.0, resolution=0.001, max_nodes=10, min_nodes=2, min_seeds=1, step=0.01, most=1).collect()
    assert sorted(r["node"] for r in out) == list(range(24)) and {r["size"] for r in out} == {8}


def test_communities_of_hits(spark):
    hits = spark.createDataFrame([("x", "a", "y", "b", 0.5), ("y", "b", "z", "c", 0.4), ("x", "d", "y", "e", 0.9)], "origin_a string, module_a string, origin_b string, module_b string, similarity double")
    out = communities.hit_communities(hits, (0.5, 1.0)).collect()
    for r in (0.5, 1.0):
        label = {(x["origin"], x["module"]): x["label"] for x in out if x["resolution"] == r}
        assert len(label) == 5 and label["x", "a"] == label["y", "b"] == label["z", "c"] != label["x", "d"] == label["y", "e"]
        assert {round(x["modularity"], 9) for x in out if x["resolution"] == r} == {0.5}
    steps = communities.resolution_steps()
    assert len(steps) == 15 and abs(steps[0] - 0.1) < 1e-12 and abs(steps[7] - 1) < 1e-9


def test_rounds_send_no_tables_through_the_driver(spark):
    """Small tables too are met by shuffles: there is one a join, a round and a level."""
    way = spark.createDataFrame([(1.0, 0, 1, 1.0), (1.0, 1, 0, 1.0)], "resolution double, src long, dst long, weight double")
    nodes = spark.createDataFrame([(1.0, 0, 1.0, 0, 0), (1.0, 1, 1.0, 1, 1)], "resolution double, node long, k double, community long, part long")
    way, nodes = written(way), written(nodes)  # so their sizes are known
    for df in (communities._shifted(way, nodes.drop("part"), {1.0: 2.0}, 2), communities._parts(way, nodes, {1.0: 2.0}, 2, 0)):
        assert df.count() == 2 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
