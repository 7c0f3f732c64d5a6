"""Ranked search against scoring every document, and its trees against plain sums."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import ODD, small
from helixframe.llm import ranked_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=20):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores, asked = [], Counter(terms(text))
        for i, c in tf:
            n, s = sum(c.values()), 0
            m = 75 + 25 * n * n_docs // length
            for t, times in asked.items():
                if t in c:
                    s += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted(str(tuple(r)) for r in ranked_search.search(d, spark.createDataFrame(items, "item_id long, text string"), **more).select("item_id", "rank", "doc_id", "score").collect())


def benchmark():
    return duckdb.sql("select item_id, text from '/root/testdata/sf0.001/benchmark.parquet' order by 1").fetchall()


@pytest.fixture
def narrow(monkeypatch):
    """Ranges of few documents and small steps."""
    monkeypatch.setattr(ranked_search, "OPEN_FIRST", 1)
    monkeypatch.setattr(ranked_search, "OPEN_MOST", 2)


def test_search(spark):
    docs = small() + [(5000 + i, f"copy of an item {benchmark()[0][1]}") for i in range(70)] + ODD  # more ties than ranks
    items = benchmark() + [(900, "the THE Don't 12½ ΣΑΣ"), (901, None), (902, " ,"), (903, "zzzzz"), (None, "the token"), (0, "the token"), (0, "the token")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, item_bytes=3000) == want  # several passes
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_long_texts_and_common_words(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(rng.choices(words, range(40, 0, -1), k=rng.randrange(1, 30)))) for i in range(3000)]
    docs += [(10_000, " ".join(rng.choices(words, k=500_000))), (10_001, "x" * 3_000_000), (10_002, "é" * 9 + " w1" * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=6))) for k in range(8)] + [(50, "x" * 3_000_000), (51, "w1 " * 20_000)]
    assert run(spark, docs, items, parts=2) == brute(docs, items)


def test_empty_and_clashing(spark, odd, none):
    items = spark.createDataFrame(benchmark(), "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(odd, items.limit(0)).count() == 0
    clash = odd.selectExpr("*", "1 as n", "2 as score", "3 as q", "4 as terms")
    got = ranked_search.search(clash, items.selectExpr("*", "1 as doc_id", "2 as q", "3 as pass"))
    assert sorted(map(str, map(tuple, got.collect()))) == brute(ODD, benchmark())
    texts = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    got = ranked_search.search(texts, spark.createDataFrame([("x", "two")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [("x", "a"), ("x", "b"), ("x", None)]


def test_trees_open_what_may_be_among_the_best(narrow):
    rng = np.random.default_rng(2)
    for size in (1, 15, 17, 300, 5000):
        pairs = np.unique(rng.integers(0, [12, size], (4 * size, 2)), axis=0)
        gain = rng.integers(1, 6, len(pairs)).astype(np.int64)  # many ties
        trees = ranked_search.MaxTrees(pairs[:, 0], pairs[:, 1], gain, 12)
        dense = np.zeros((12, size), np.int64)
        dense[pairs[:, 0], pairs[:, 1]] = gain
        for _ in range(20):
            own = rng.choice(12, 4, replace=False)
            times = rng.integers(1, 4, 4)
            score = times @ dense[own]
            opened = []
            best = ranked_search.Best(7)

            def found(docs, scores, best=best, opened=opened, score=score):
                assert (score[docs] == scores).all()
                opened.extend(docs.tolist())
                return best.add(list(range(size)), docs, scores)

            trees.search(own, times, best.worst, found)
            want = sorted((-int(s), False, d) for d, s in enumerate(score) if s > 0)[:7]
            assert best.rows == want and len(opened) == len(set(opened))


def test_trees_leave_nodes_closed():
    rng = np.random.default_rng(4)
    docs = np.arange(1 << ranked_search.RANGE)
    gain = rng.integers(1, 100, len(docs)).astype(np.int64)
    gain[5000:5040] = 10_000
    trees = ranked_search.MaxTrees(np.zeros(len(docs), np.int64), docs, gain, 1)
    best, opened = ranked_search.Best(20), []

    def found(docs, scores):
        opened.extend(docs.tolist())
        return best.add(list(range(len(gain))), docs, scores)

    trees.search(np.array([0]), np.array([1]), best.worst, found)
    assert [d for _, _, d in best.rows] == list(range(5000, 5020)) and len(opened) < 1000


def test_ranges_of_documents(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ranked_search, "POSTINGS", 50)
    rng = random.Random(3)
    lists = [[rng.randrange(9) for _ in range(rng.choice([0, 1, 7, 120]))] for _ in range(400)]
    batches = [pa.record_batch([list(range(k, k + 100)), [len(x) for x in lists[k : k + 100]], pa.array(lists[k : k + 100], pa.list_(pa.int32())), pa.array(lists[k : k + 100], pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"]) for k in range(0, 400, 100)]
    got = list(ranked_search._document_ranges(iter(batches)))
    assert [i for ids, *_ in got for i in ids] == list(range(400))
    assert np.concatenate([g[3] for g in got]).tolist() == [t for x in lists for t in x]
    assert all(g[2].sum() == len(g[3]) and (len(g[0]) == 1 or g[2][:-1].sum() < 50) for g in got)
