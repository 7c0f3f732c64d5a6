"""Ranked lexical search with max trees over document ranges.

Scores are integers in the manner of BM25. One pass over the documents counts the terms that items ask for and writes them;
what it writes gives the statistics of the whole corpus and is then read in ranges of documents. Within a range each term
has a tree: leaves are the documents that hold the term with the term's share of their score, inner nodes the maximum over
sixteen children. An item's search descends these trees together: the bound of a node is the sum of its terms' maxima, the
nodes with the highest bounds are opened first, and none that could still reach the worst of the best documents found, or
equal it, stays closed. A task keeps its best documents from range to range, so later ranges open little. Nothing is
shuffled but the best few of each task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import documents, small_batches, written

TOP = 20
#: A parameter of the scores: a document's length counts by this many hundredths.
LENGTH_SHARE = 25
#: Bytes of item texts whose terms one pass over the documents looks up; more items take further passes.
ITEM_BYTES = 8_000_000
#: A tree's nodes have 2**FAN children; a range of documents has at most 2**RANGE documents and about POSTINGS entries.
FAN, RANGE, POSTINGS = 4, 14, 4_000_000
LEVELS = 4
#: Nodes that a step opens: at first, and at most, doubling in between.
OPEN_FIRST, OPEN_MOST = 16, 512
#: Parts in which the best of all tasks are ranked before they are ranked together.
PARTS = 64

#: Bytes of UTF-8 that belong to terms are lower-cased if they are A-Z; all others become blanks.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_TABLE).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _totals(nodes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of values by node, exact."""
    if len(values) and int(values.max()) * len(values) >= 2**53:
        out = np.zeros(size, np.int64)
        np.add.at(out, nodes, values)
        return out
    return np.bincount(nodes, weights=values, minlength=size).astype(np.int64)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all ranges, the range of each)."""
    sizes = stop - start
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes), owner


class MaxTrees:
    """The trees of all terms over one range of documents. Level 0 are documents; an entry of a level is a node of a term,
    sorted by (term, node), and the entries below it are contiguous."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((doc, term))
        term, node, value = term[order].astype(np.int64), doc[order].astype(np.int64), gain[order]
        self.nodes, self.values, self.below = [node], [value], [np.zeros(0, np.int64)]
        for _ in range(1, LEVELS):
            node = node >> FAN
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])]))
            value = np.maximum.reduceat(value, new)
            self.below.append(np.concatenate([new, [len(term)]]))
            term, node = term[new], node[new]
            self.nodes.append(node)
            self.values.append(value)
        self.first = np.searchsorted(term, np.arange(n_terms + 1))  # of each term's entries at the top level

    def search(self, terms: np.ndarray, times: np.ndarray, worst: int, found) -> None:
        """Calls found(documents, scores) for what may be among the best; it returns the score that others must reach."""
        at, owner = _ranges(self.first[terms], self.first[terms + 1])
        frontier = [self._nodes(LEVELS - 1, at, times[owner])]
        width = OPEN_FIRST
        while True:
            bounds = np.concatenate([f[1] for f in frontier])
            live = np.flatnonzero(bounds >= worst)
            if not len(live):
                return
            if len(live) > width:
                live = live[np.argpartition(-bounds[live], width)[:width]]
            width = min(OPEN_MOST, width * 2)
            ahead, base = [], 0
            for level, bound, entry, node_of, weight_of in frontier:
                mine = live[(live >= base) & (live < base + len(bound))] - base
                base += len(bound)
                opened = np.zeros(len(bound), bool)
                opened[mine] = True
                stay = ~opened & (bound >= worst)
                if len(mine):
                    pick = opened[node_of]
                    at, owner = _ranges(self.below[level][entry[pick]], self.below[level][entry[pick] + 1])
                    child = self._nodes(level - 1, at, weight_of[pick][owner])
                    if level == 1:
                        worst = found(self.nodes[0][at][np.unique(child[3], return_index=True)[1]], child[1])
                    else:
                        ahead.append(child)
                if stay.any():
                    if not stay.all():
                        keep = stay[node_of]
                        entry, weight_of = entry[keep], weight_of[keep]
                        node_of = (np.cumsum(stay) - 1)[node_of[keep]]
                        bound = bound[stay]
                    ahead.append((level, bound, entry, node_of, weight_of))
            if not ahead:
                return
            frontier = ahead

    def _nodes(self, level: int, entry: np.ndarray, times: np.ndarray) -> tuple:
        """(level, bound of each node, entries, node of each entry, weight of each entry)."""
        _, node_of = np.unique(self.nodes[level][entry], return_inverse=True)
        size = int(node_of.max()) + 1 if len(node_of) else 0
        return level, _totals(node_of, self.values[level][entry] * times, size), entry, node_of, times


class Best:
    """The best documents of an item so far: by score, then by id, rows without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, []

    @property
    def worst(self) -> int:
        """The score that a document must reach."""
        return self.rows[-1][0] * -1 if len(self.rows) == self.k else 1

    def add(self, ids: list, docs: np.ndarray, scores: np.ndarray) -> int:
        good = np.flatnonzero(scores >= self.worst)
        if len(good) > self.k:  # what is below the k-th of these alone can't stay
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        new = [(-s, ids[d] is None, ids[d] if ids[d] is not None else 0) for d, s in zip(docs[good].tolist(), scores[good].tolist(), strict=True)]
        self.rows = sorted(self.rows + new)[: self.k]
        return self.worst


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows of documents() with at least one term; n counts all terms, and only those of the
    vocabulary are listed."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, terms, tfs, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                if not words:
                    continue
                held = Counter(map(vocabulary.get, words))
                held.pop(None, None)
                at.append(i)
                n.append(len(words))
                terms += held.keys()
                tfs += held.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            out = pa.schema([batch.schema.field(0), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(n, pa.int64()), *lists], schema=out)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(count, schema)


def _document_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, n, number of entries, terms, tfs) of ranges of documents."""
    held, docs, entries = [], 0, 0

    def joined():
        ids = [x for b, *_ in held for x in b]
        return (ids, *(np.concatenate([h[k] for h in held]) for k in range(1, 5)))

    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        terms, tfs = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
        ids, n, start = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), 0
        while start < len(sizes):
            room = max(1, int(np.searchsorted(ends, ends[start] + POSTINGS - entries, side="right")) - 1 - start)
            stop = min(len(sizes), start + room, start + (1 << RANGE) - docs)
            held.append((ids[start:stop], n[start:stop], sizes[start:stop], terms[ends[start] : ends[stop]], tfs[ends[start] : ends[stop]]))
            docs, entries = docs + stop - start, entries + int(ends[stop] - ends[start])
            start = stop
            if docs == 1 << RANGE or entries >= POSTINGS:
                yield joined()
                held, docs, entries = [], 0, 0
    if held:
        yield joined()


def gains(n: np.ndarray, tf: np.ndarray, w: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What a term adds to the score of a document, in 64-bit integers."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // all_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def best(counted: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, all_terms: int, top: int) -> DataFrame:
    """(q, doc_id, score): each task's best documents for each query, a query being (terms, how often each)."""
    schema = T.StructType([T.StructField("q", T.IntegerType()), counted.schema["doc_id"], T.StructField("score", T.LongType())])

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(top) for _ in queries]
        kind: Any = None

        def watched():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0)
                yield batch

        for ids, n, sizes, terms, tfs in _document_ranges(watched()):
            if not len(terms):
                continue
            owner = np.repeat(np.arange(len(sizes)), sizes)
            gain = gains(n[owner], tfs, weights[terms], n_docs, all_terms)
            # Documents whose rarest term is the same become neighbours: so maxima of unlike documents meet in few nodes.
            rarest = np.full(len(sizes), -1, np.int64)
            np.maximum.at(rarest, owner, weights[terms] << 32 | terms)
            place = np.empty(len(sizes), np.int64)
            by_rarest = np.lexsort((np.arange(len(sizes)), rarest))
            place[by_rarest] = np.arange(len(sizes))
            trees = MaxTrees(terms, place[owner], gain, len(weights))
            for (own, times), one in zip(queries, found, strict=True):
                trees.search(own, times, one.worst, lambda docs, scores, one=one: one.add(ids, by_rarest[docs], scores))
        q, rows = [k for k, one in enumerate(found) for _ in one.rows], [r for one in found for r in one.rows]
        if rows:
            ids = pa.array([None if null else i for _, null, i in rows], kind.type)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), ids, pa.array([-r[0] for r in rows], pa.int64())], schema=pa.schema([("q", pa.int32()), kind, ("score", pa.int64())]))

    return counted.mapInArrow(search_all, schema)


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The `top` documents of each item with scores above 0: item_id, rank, doc_id, score.

    A null text has no terms; a document without terms counts nowhere, an item without terms finds nothing. Equal scores go
    by ascending id, rows without an id last; rows that agree in both have consecutive ranks. Each row of `items` is an
    item, also where ids are null or repeated. Terms of any length and texts of any length are taken whole. Empty tables
    give no rows; other columns are ignored. The documents are scanned once for each `item_bytes` of item texts, since a
    pass holds the terms of its items in every task."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col)
    asked = items.select(items[item_col].alias("item_id"), F.coalesce(items[item_text_col], F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // item_bytes))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    schema = T.StructType([T.StructField("q", T.IntegerType()), asked.schema["item_id"]])
    found = []
    for k in range(passes):
        own = asked.filter(F.col("pass") == k).collect()  # at most about item_bytes, or one long item
        vocabulary: dict[bytes, int] = {}
        wanted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(r["text"])) for r in own]
        counted = written(postings(docs, vocabulary))
        stats = counted.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_terms")).first()
        df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        weights = np.array([weight(stats["n_docs"], df.get(t, 0)) for t in range(len(vocabulary))], np.int64)
        queries = [(np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))) for c in wanted]
        rows = best(counted, queries, weights, stats["n_docs"], stats["all_terms"], top)
        rows = _ranked(rows.withColumn("part", F.spark_partition_id() % PARTS), ["q", "part"], top).drop("part")
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], schema)
        found.append(_ranked(rows, ["q"], top).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), c),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // all_terms)))) AS BIGINT) AS score FROM p JOIN w USING (term) JOIN q USING (term), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
