"""Exact dedup and sharding, against brute force."""

import hashlib
import random
import zlib

from conftest_llm import ODD, small
from helixframe.llm import bloom, exact_dedup, sharding


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exact_dedup(spark, odd, none):
    docs = small() + [(5000 + i, "copy") for i in range(500)] + ODD
    for bits in (bloom.LANE, None):
        got = exact_dedup.exact_dedup(rows_of(spark, docs), bits=bits).collect()
        groups = {}
        for i, t in docs:
            groups.setdefault(t or "", []).append(i)
        want = []
        for i, t in docs:
            g = groups[t or ""]
            top = max((x for x in g if x is not None), default=None)
            want.append((i, top, len(g), i == top, hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.exact_dedup(odd).count() == odd.count()


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(50):
        items = [(i, rng.randrange(1, 60)) for i in range(rng.randrange(1, 80))]
        where = sharding.best_fit_decreasing(items, 100)
        left: list[int] = []
        want = {}
        for i, s in sorted(items, key=lambda x: (-x[1], str(x[0]))):  # the rule, by a plain scan
            fits = [(r, b) for b, r in enumerate(left) if r >= s]
            b = min(fits)[1] if fits else len(left)
            if not fits:
                left.append(100)
            left[b] -= s
            want[i] = b
        assert where == want


def check_shards(docs, got, shards):
    assert len(got) == len(docs)
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    assert want == sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_sharding(spark, odd, none):
    docs = small()
    got = sharding.shard(rows_of(spark, docs)).collect()
    sizes = check_shards(docs, got, 8)
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 8 + max(len((t or "").encode()) for _, t in docs)
    by = {}
    for r in got:
        by.setdefault(dict(docs)[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    hot = docs + [(10_000 + i, "hot text " * 30) for i in range(3000)]
    sizes = check_shards(hot, sharding.shard(rows_of(spark, hot)).collect(), 8)
    assert max(sizes) < 1.1 * min(sizes)
    assert sharding.shard(none).count() == 0 and sharding.shard(odd).count() == odd.count()
    cap = sharding.shard(rows_of(spark, docs), shards=None, capacity=100_000).groupBy("shard").sum("size").collect()
    assert all(r["sum(size)"] <= 100_000 for r in cap)
