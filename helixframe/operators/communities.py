"""Communities of graphs (src, dst, weight), and signals smoothed over graphs."""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.ranges import positions
from helixframe.operators.graphs import both_ways
from helixframe.session import cut, sweep, tables, written

#: Directed edges of a block of nodes, about: what one task moves at a time.
BLOCK_EDGES = 2_000_000
_KEYS = ["resolution", "block"]


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (node, label) over undirected edges, each given once; a self-loop counts twice in its node's degree."""
    return _quality(_directed(edges), labels, resolution)


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle on both sides: tables of nodes in rounds would go through the driver as often as there are rounds."""
    return left.join(right.hint("merge"), on, how)


def _directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, summed, so that a row's sum is the degree."""
    return both_ways(edges.filter("weight > 0 and src is not null and dst is not null")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _quality(way: DataFrame, labels: DataFrame, resolution: float) -> float:
    of = lambda n, l: labels.select(F.col("node").alias(n), F.col("label").alias(l))
    e = way.join(of("src", "a"), "src").join(of("dst", "b"), "dst")
    s = e.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("all"))
    r = s.agg(F.sum("inner").alias("i"), F.sum("all").alias("m"), F.sum(F.col("all") ** 2).alias("q")).first()
    return 0.0 if not r["m"] else r["i"] / r["m"] - resolution * r["q"] / r["m"] ** 2


class _Block:
    """The nodes of a block with their edges: from rows (node, dst, weight, label, size, members), the node's own row with
    dst null and its degree as the weight. Labels of nodes in other blocks are those of the last round."""

    def __init__(self, rows: pd.DataFrame) -> None:
        own = rows[rows["dst"].isna()].sort_values("node")
        edges = rows[rows["dst"].notna()]
        self.node = own["node"].to_numpy(np.int64)
        self.degree = own["weight"].to_numpy(np.float64)
        self.names, codes = np.unique(np.concatenate([own["label"].to_numpy(np.int64), edges["label"].to_numpy(np.int64)]), return_inverse=True)
        self.label = codes[: len(own)].tolist()
        seen = np.concatenate([own["size"].to_numpy(np.float64), edges["size"].to_numpy(np.float64)])
        some = np.concatenate([own["members"].to_numpy(np.int64), edges["members"].to_numpy(np.int64)])
        size, members = np.zeros(len(self.names)), np.zeros(len(self.names), np.int64)
        size[codes], members[codes] = seen, some
        self.size, self.members = size.tolist(), members.tolist()
        src = np.searchsorted(self.node, edges["node"].to_numpy(np.int64))
        dst = edges["dst"].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(self.node, dst), len(self.node) - 1)
        inside = np.where(self.node[at] == dst, at, -1)
        order = np.lexsort((dst, src))
        self.first = np.searchsorted(src[order], np.arange(len(self.node) + 1)).tolist()
        self.to, self.outer, self.weight = inside[order].tolist(), codes[len(own) :][order].tolist(), edges["weight"].to_numpy(np.float64)[order].tolist()
        mine = set(own["label"].tolist()) | set(self.node.tolist())
        self.ours = [int(x) in mine for x in self.names]

    def around(self, v: int) -> dict[int, float]:
        """Weight of a node's edges by label."""
        out: dict[int, float] = {}
        for e in range(self.first[v], self.first[v + 1]):
            l = self.label[self.to[e]] if self.to[e] >= 0 else self.outer[e]
            out[l] = out.get(l, 0.0) + self.weight[e]
        return out

    def put(self, v: int, to: int) -> None:
        own = self.label[v]
        self.size[own] -= self.degree[v]
        self.members[own] -= 1
        self.size[to] += self.degree[v]
        self.members[to] += 1
        self.label[v] = to

    def inner(self, v: int) -> list[int]:
        return [self.to[e] for e in range(self.first[v], self.first[v + 1]) if self.to[e] >= 0]

    def moved(self, rate: float) -> int:
        """Moves nodes to the neighbouring community of the largest gain until none gains; a node is looked at again when a
        neighbour has moved elsewhere. Two nodes that are alone, in two blocks, do not swap: only one may follow."""
        queue, waiting, moves = deque(range(len(self.node))), [True] * len(self.node), 0
        while queue:
            v = queue.popleft()
            waiting[v] = False
            near, own, k = self.around(v), self.label[v], self.degree[v]
            stay = near.pop(own, 0.0) - rate * k * (self.size[own] - k)
            best, to = stay + 1e-9, own
            for l, w in near.items():
                gain = w - rate * k * self.size[l]
                if gain > best + 1e-12 or (gain > best - 1e-12 and to != own and l < to):
                    if self.members[own] == 1 and self.members[l] == 1 and not self.ours[l] and l > own:
                        continue
                    best, to = gain, l
            if to != own:
                self.put(v, to)
                moves += 1
                for u in self.inner(v):
                    if self.label[u] != to and not waiting[u]:
                        waiting[u] = True
                        queue.append(u)
        return moves

    def refined(self, rate: float, community: dict[int, float], moving: bool) -> None:
        """Merges nodes that are alone into parts of their community, here one per label; edges lead to the same community
        only. Parts of several nodes keep them all, so a part grows along edges and is connected. Nodes alone in other
        blocks are followed only in rounds in which those blocks stay."""
        for v in range(len(self.node)):
            own, k, all_ = self.label[v], self.degree[v], community[v]
            if self.members[own] > 1 or not moving:
                continue
            near = self.around(v)
            near.pop(own, None)
            if sum(near.values()) < rate * k * (all_ - k):  # too weakly held by the rest of its community
                continue
            best, to = 1e-9, own
            for l, w in near.items():
                gain = w - rate * k * self.size[l]
                if gain > best + 1e-12 or (gain > best - 1e-12 and to != own and l < to):
                    if self.members[l] > 1 or self.ours[l] or self.stays[l]:
                        best, to = gain, l
            if to != own:
                self.put(v, to)


def _frames(way: DataFrame, nodes: DataFrame, by: str, blocks: int) -> DataFrame:
    """Rows for blocks of nodes: edges with the label of their end, and the nodes. `by` names the labels' column."""
    size = nodes.groupBy("resolution", by).agg(F.sum("k").alias("size"), F.count("*").alias("members"))
    known = _met(nodes, size, ["resolution", by])
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")
    own = known.select("resolution", block, "node", F.lit(None).cast("long").alias("dst"), F.col("k").alias("weight"), F.col(by).alias("label"), "size", "members", "community")
    end = known.select("resolution", F.col("node").alias("dst"), F.col(by).alias("label"), "size", "members", F.col("community").alias("there"))
    ways = _met(way, end, ["resolution", "dst"]).withColumnRenamed("src", "node")
    return own.unionByName(ways.select("resolution", block, "node", "dst", "weight", "label", "size", "members", F.col("there").alias("community")))


def _shifted(way: DataFrame, nodes: DataFrame, totals: dict[float, float], blocks: int) -> DataFrame:
    """Nodes (resolution, node, k, community, moved) after one round of moves in all blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = float(rows["resolution"].iloc[0])
        block = _Block(rows)
        before = list(block.label)
        block.moved(r / totals[r])
        return pd.DataFrame({"resolution": r, "node": block.node, "k": block.degree, "community": block.names[block.label], "moved": [a != b for a, b in zip(before, block.label, strict=True)]})

    return _frames(way, nodes, "community", blocks).groupBy(*_KEYS).applyInPandas(run, "resolution double, node long, k double, community long, moved boolean")


def _inner(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside communities."""
    of = lambda n, l: nodes.select("resolution", F.col("node").alias(n), F.col("community").alias(l))
    return _met(_met(way, of("src", "a"), ["resolution", "src"]), of("dst", "b"), ["resolution", "dst"]).filter("a = b").drop("a", "b")


def _parts(way: DataFrame, nodes: DataFrame, totals: dict[float, float], blocks: int, turn: int) -> DataFrame:
    """Nodes (resolution, node, k, community, part) after one round of merging inside communities."""
    inner = _inner(way, nodes)
    whole = nodes.groupBy("resolution", "community").agg(F.sum("k").alias("whole"))
    turns = lambda b: (b * 2654435761 + turn * 40503) >> 7 & 1  # noqa: E731  of blocks, at random
    rows = _met(_frames(inner, nodes, "part", blocks), whole, ["resolution", "community"])
    rows = rows.withColumn("home", F.pmod(F.xxhash64("label"), F.lit(blocks)))  # the block of the node that names a part

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, b = float(pdf["resolution"].iloc[0]), int(pdf["block"].iloc[0])
        block = _Block(pdf)
        own = pdf[pdf["dst"].isna()].sort_values("node")
        homes = dict(zip(pdf["label"].tolist(), pdf["home"].tolist(), strict=True))
        block.stays = [not turns(homes[int(x)]) for x in block.names]
        block.refined(r / totals[r], own["whole"].tolist(), blocks == 1 or bool(turns(b)))
        return pd.DataFrame({"resolution": r, "node": block.node, "k": block.degree, "community": own["community"].to_numpy(), "part": block.names[block.label]})

    return rows.groupBy(*_KEYS).applyInPandas(run, "resolution double, node long, k double, community long, part long")


def _connected(way: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with `community` cut into its connected pieces, named by their smallest node."""
    inner = written(_inner(way.filter("src <> dst"), nodes).select("resolution", "src", "dst"))
    state = nodes.select("resolution", "node", F.col("node").alias("piece"))
    while True:
        near = _met(inner, state.withColumnRenamed("node", "dst"), ["resolution", "dst"]).select("resolution", F.col("src").alias("node"), "piece")
        least = state.unionByName(near).groupBy("resolution", "node").agg(F.min("piece").alias("piece"))
        jump = least.select("resolution", F.col("node").alias("piece"), F.col("piece").alias("further"))
        new = _met(least, jump, ["resolution", "piece"]).select("resolution", "node", F.col("further").alias("piece"))
        new = written(_met(new, state.withColumnRenamed("piece", "was"), ["resolution", "node"]))
        state = new.select("resolution", "node", "piece")
        if not new.filter("piece <> was").head(1):
            return _met(nodes.drop("community"), state.withColumnRenamed("piece", "community"), ["resolution", "node"])


def _block_rows(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, node: np.ndarray, k: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """The rows that _Block takes of a whole graph: edges between the numbers of nodes in `node`, which is sorted."""
    names, codes = np.unique(label, return_inverse=True)
    size, members = np.bincount(codes, k, len(names)), np.bincount(codes, minlength=len(names))
    of = np.concatenate([np.arange(len(node)), dst])
    no = pd.Series(pd.NA, range(len(node)), "Int64")
    ends = pd.concat([no, pd.Series(node[dst], dtype="Int64")], ignore_index=True)
    return pd.DataFrame({"node": node[np.concatenate([np.arange(len(node)), src])], "dst": ends, "weight": np.concatenate([k, weight]), "label": label[of], "size": size[codes[of]], "members": members[codes[of]]})


def _pieces(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the connected nodes 0 to n - 1 for each of them."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, src, root[dst])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _ended(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, node: np.ndarray, k: np.ndarray, community: np.ndarray, rate: float, levels: int, refine: bool) -> np.ndarray:
    """Communities of the nodes of a graph of one block after all levels, as leiden() finds them; edges are between the
    numbers of nodes in `node`, which is sorted."""
    at = np.arange(len(node))  # the node of the level that each node has become part of
    for _ in range(levels):
        link = src != dst
        block = _Block(_block_rows(src[link], dst[link], weight[link], node, k, community))
        moves = block.moved(rate)
        community = block.names[block.label]
        if not moves:
            break
        part = community
        if refine:
            link &= community[src] == community[dst]
            block = _Block(_block_rows(src[link], dst[link], weight[link], node, k, node))
            codes = np.unique(community, return_inverse=True)[1]
            block.refined(rate, np.bincount(codes, k)[codes].tolist(), True)
            part = block.names[block.label]
        node, codes = np.unique(part, return_inverse=True)
        at = codes[at]
        k = np.bincount(codes, k, len(node))
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, codes, community)
        community = least
        pair, place = np.unique(codes[src] * len(node) + codes[dst], return_inverse=True)
        weight = np.bincount(place, weight, len(pair))
        src, dst = pair // len(node), pair % len(node)
    if refine:
        link = community[src] == community[dst]
        community = node[_pieces(src[link], dst[link], len(node))]
    return community[at]


def _finished(way: DataFrame, nodes: DataFrame, totals: dict[float, float], levels: int, refine: bool) -> DataFrame:
    """(resolution, node, community) of nodes (resolution, node, k, community) whose edges fit one block: the levels that
    are left, a task a resolution."""
    none = F.lit(None).cast("long")
    rows = way.select("resolution", "src", "dst", "weight", none.alias("community")).unionByName(nodes.select("resolution", F.col("node").alias("src"), none.alias("dst"), F.col("k").alias("weight"), "community"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = float(pdf["resolution"].iloc[0])
        own = pdf[pdf["dst"].isna()].sort_values("src")
        edges = pdf[pdf["dst"].notna()]
        node = own["src"].to_numpy(np.int64)
        src, dst = (np.searchsorted(node, edges[c].to_numpy(np.int64)) for c in ("src", "dst"))
        found = _ended(src, dst, edges["weight"].to_numpy(np.float64), node, own["weight"].to_numpy(np.float64), own["community"].to_numpy(np.int64), r / totals[r], levels, refine)
        return pd.DataFrame({"resolution": r, "node": node, "community": found})

    return rows.groupBy("resolution").applyInPandas(run, "resolution double, node long, community long")


def leiden(edges: DataFrame, resolutions: Sequence[float] = (1.0,), levels: int = 5, rounds: int = 8, refine: bool = True, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(resolution, node, label): communities of high modularity at every resolution, all in the same passes, with the
    resolution as a key; a label is the smallest node of its community.

    A level moves nodes, refines, and contracts. Nodes are dealt to blocks of about `block_edges` edges. A block moves its
    nodes one after the other, with a queue of those whose neighbourhood has changed, until none gains, knowing the labels
    of other blocks as of the last round; rounds end when no block moves a node, or after `rounds` of them. Refining starts
    anew from single nodes and merges them inside their community only; what it gives becomes the nodes of the next level,
    which start in their communities, so that badly attached parts can leave. In the end communities are cut into connected
    pieces, which can only raise modularity, so every community is connected. Without `refine` whole communities are
    contracted (Louvain's method). Sums by label are joined, never gathered, but a node's edges meet in its block. Once the
    edges of a level fit one block, a task a resolution goes through the levels that are left. Joins of the rounds are
    shuffles, so no table of nodes goes through the driver.

    Edges without positive weight are left out, and nodes without edges have no row."""
    before = tables()
    keyed = F.explode(F.array(*(F.lit(float(r)) for r in dict.fromkeys(resolutions)))).alias("resolution")
    way = written(_directed(edges).select(keyed, "src", "dst", "weight"))
    found = way.groupBy("resolution").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).collect()  # a row a resolution
    totals = {r["resolution"]: r["total"] for r in found}
    n_edges = max((r["n"] for r in found), default=0)
    nodes = written(way.groupBy("resolution", F.col("src").alias("node")).agg(F.sum("weight").alias("k")).withColumn("community", F.col("node")))
    every, done = None, False
    for level in range(levels):
        blocks = n_edges // block_edges + 1
        if blocks == 1:
            nodes, done = written(_finished(way, nodes, totals, levels - level, refine)), True
            break
        links, any_moved = way.filter("src <> dst"), False
        for _ in range(rounds):
            shifted = written(_shifted(links, nodes, totals, blocks))
            moves = shifted.filter("moved").count()
            any_moved |= moves > 0
            nodes = shifted.drop("moved")
            if not moves:
                break
        if not any_moved:
            break
        parts = nodes.withColumn("part", F.col("node") if refine else F.col("community"))
        for turn in range(6 if refine else 0):
            parts = written(_parts(links, parts, totals, blocks, turn))
        of = lambda n: parts.select("resolution", F.col("node").alias(n), F.col("part").alias(f"{n}_to"))  # noqa: E731, B023
        mine = of("node").withColumnRenamed("node_to", "at") if every is None else _met(every, of("at"), ["resolution", "at"]).select("resolution", "node", F.col("at_to").alias("at"))
        every = written(mine)
        way = written(_met(_met(way, of("src"), ["resolution", "src"]), of("dst"), ["resolution", "dst"]).groupBy("resolution", F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).agg(F.sum("weight").alias("weight")))
        nodes = written(parts.groupBy("resolution", F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.min("community").alias("community")))
        n_edges = max((r["n"] for r in way.groupBy("resolution").agg(F.count("*").alias("n")).collect()), default=0)  # a row a resolution
    if refine and not done:
        nodes = _connected(way, nodes)
    last = nodes.select("resolution", F.col("node").alias("at"), "community")
    told = _met(every, last, ["resolution", "at"]) if every is not None else last.withColumnRenamed("at", "node")
    least = told.groupBy("resolution", "community").agg(F.min("node").alias("label"))
    out = written(_met(told, least, ["resolution", "community"]).select("resolution", "node", "label"))
    sweep(edges.sparkSession, before, out)
    return out


def louvain(edges: DataFrame, resolution: float = 1.0, levels: int = 5, rounds: int = 8) -> DataFrame:
    """(node, label): as leiden(), without refinement, at one resolution; communities may be disconnected."""
    return leiden(edges, (resolution,), levels, rounds, refine=False).select("node", "label")


def _by_resolution(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(resolution, n_communities, largest, i, m, q): weights inside, in all, and squared sums of degrees of communities."""
    way = _directed(edges)
    of = lambda n, l: labels.select("resolution", F.col("node").alias(n), F.col("label").alias(l))
    e = _met(_met(way, of("src", "a"), "src"), of("dst", "b"), ["resolution", "dst"])
    s = e.groupBy("resolution", F.col("a").alias("label")).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inner"), F.sum("weight").alias("all"))
    s = _met(s, labels.groupBy("resolution", "label").agg(F.count("*").alias("size")), ["resolution", "label"])
    return s.groupBy("resolution").agg(F.count("*").alias("n_communities"), F.max("size").alias("largest"), F.sum("inner").alias("i"), F.sum("all").alias("m"), F.sum(F.col("all") ** 2).alias("q"))


def resolution_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(resolution, n_communities, largest, modularity) of labels (resolution, node, label)."""
    return _by_resolution(edges, labels).select("resolution", "n_communities", "largest", (F.col("i") / F.col("m") - F.col("resolution") * F.col("q") / F.col("m") ** 2).alias("modularity"))


def resolution_steps(low: float = 0.1, high: float = 10.0, number: int = 15) -> list[float]:
    """Resolutions at equal ratios."""
    return [float(x) for x in np.geomspace(low, high, number)]


def hit_communities(hits: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """(resolution, origin, module, label, modularity): communities of reciprocal best hits (origin_a, module_a, origin_b,
    module_b, similarity) at every resolution; modularity is that of the resolution's communities at a resolution of one.
    Labels are numbers of modules in the order of origin and name."""
    of = lambda x: hits.select(F.col(f"origin_{x}").alias("origin"), F.col(f"module_{x}").alias("module"))
    names = written(positions(of("a").unionByName(of("b")).distinct(), "origin", "module"))
    at = lambda x, n: names.select(F.col("origin").alias(f"origin_{x}"), F.col("module").alias(f"module_{x}"), F.col("position").alias(n))
    edges = written(hits.join(at("a", "src"), ["origin_a", "module_a"]).join(at("b", "dst"), ["origin_b", "module_b"]).select("src", "dst", F.col("similarity").alias("weight")))
    found = leiden(edges, resolutions)
    quality = _by_resolution(edges, found).select("resolution", (F.col("i") / F.col("m") - F.col("q") / F.col("m") ** 2).alias("modularity"))
    return found.join(names.withColumnRenamed("position", "node"), "node").join(quality, "resolution").select("resolution", "origin", "module", "label", "modularity")


def privileged_communities(edges: DataFrame, scores: DataFrame, *seeds: DataFrame, share: float = 0.5, resolution: float = 0.5, max_nodes: int = 300, min_nodes: int = 10, min_seeds: int = 2, step: float = 0.05, most: int = 100) -> DataFrame:
    """(node, label, size, seeds_1, ...): communities of the part of a graph that a diffusion reaches best, which hold at least
    `min_nodes` nodes and at least `min_seeds` nodes of every table of seeds (node). The part is the `share` of nodes with the
    highest scores (node, score), rounded up, ties to the smaller node.

    Communities of over `max_nodes` nodes are divided again, each as a graph of its own at a resolution raised by `step` a
    time, all of them in one pass: with each graph's weights scaled to a sum of one, the sum over their number is what a
    joint pass at that number times the resolution sees. After `most` times the raise doubles from time to time, until no
    community is too large: at a resolution beyond all edges nodes stay alone. Only nodes that have no edge inside the part
    are left out."""
    before = tables()
    ranked = written(positions(scores.select("node", (-F.col("score")).alias("less")).dropna(), "less", "node"))
    kept = ranked.filter(F.col("position") <= math.ceil(share * ranked.count())).select("node")
    end = lambda c: kept.select(F.col("node").alias(c))
    inner = written(edges.join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst", "weight"))
    labels, good = leiden(inner, (resolution,)).select("node", "label"), None
    for turn in itertools.count(1):
        sized = written(labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label"))
        small = sized.filter(F.col("size") <= max_nodes)
        good = written(small if good is None else good.unionByName(small))
        big = sized.filter(F.col("size") > max_nodes).select("node", "label")
        graphs = big.select("label").distinct().count()
        if not graphs:
            break
        of = lambda c, l: big.select(F.col("node").alias(c), F.col("label").alias(l))  # noqa: E731, B023
        parts = inner.join(of("src", "a"), "src").join(of("dst", "b"), "dst").filter("a = b and weight > 0")
        total = parts.groupBy("a").agg(F.sum("weight").alias("total"))
        scaled = written(parts.join(total, "a").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight")))
        raised = step * (turn if turn <= most else most * 2.0 ** (turn - most))
        labels = leiden(scaled, ((resolution + raised) * graphs,)).select("node", "label")
    told = good
    for i, s in enumerate(seeds, 1):
        told = told.join(s.select("node").distinct().withColumn(f"s{i}", F.lit(1)), "node", "left")
    per = told.groupBy("label").agg(F.count("*").alias("size"), *(F.sum(F.coalesce(f"s{i}", F.lit(0))).alias(f"seeds_{i}") for i in range(1, len(seeds) + 1)))
    for i in range(1, len(seeds) + 1):
        per = per.filter(F.col(f"seeds_{i}") >= min_seeds)
    out = written(good.select("node", "label").join(per.filter(F.col("size") >= min_nodes), "label").select("node", "label", "size", *(f"seeds_{i}" for i in range(1, len(seeds) + 1))))
    sweep(edges.sparkSession, before, out)
    return out


def smoothed_signal(edges: DataFrame, signal: DataFrame, beta: float = 1.0, order: int = 12) -> DataFrame:
    """(node, label, value): the signal (node, label, value) under exp(-beta L), L the symmetric normalised Laplacian of
    the undirected edges, by Chebyshev polynomials: one join and one aggregate for each order. Nodes that have no edges
    keep their value times exp(-beta); missing values are zero."""
    way = cut(_directed(edges))
    degree = way.groupBy("src").agg(F.sum("weight").alias("d"))
    a = way.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst")
    a = cut(a.select("src", "dst", (F.col("weight") / F.sqrt(F.col("d") * F.col("e"))).alias("weight")))
    # With x the eigenvalues of the normalised adjacency, in -1..1, the filter is exp(-beta (1 - x)).
    c = np.polynomial.chebyshev.chebinterpolate(lambda x: np.exp(-beta * (1 - x)), order).tolist()
    last = cut(signal.groupBy("node", "label").agg(F.sum("value").alias("value")))
    out, before = last.withColumn("value", c[0] * F.col("value")), None
    for i in range(1, order + 1):
        step = a.join(last.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))
        if before is not None:
            step = step.withColumn("value", 2 * F.col("value")).unionByName(before.withColumn("value", -F.col("value"))).groupBy("node", "label").agg(F.sum("value").alias("value"))
        before, last = last, cut(step)
        out = out.unionByName(last.withColumn("value", c[i] * F.col("value")))
    return out.groupBy("node", "label").agg(F.sum("value").alias("value"))
