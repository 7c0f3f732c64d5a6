"""SimHash near-dedup and components, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import ODD, small
from helixframe.llm import graph, simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_keys_meet_for_up_to_three_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    key, row, listed = simhash.keys_of(x)
    mine = set(zip(row[listed].tolist(), key[listed].tolist(), strict=True))
    for d in range(4):
        flips = [sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in x]
        k, r, ls = simhash.keys_of(x ^ np.array(flips, np.uint64))
        assert {a for a, _ in mine & set(zip(r[~ls].tolist(), k[~ls].tolist(), strict=True))} == set(range(len(x)))


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_have_the_components_of_all_pairs(spark, hot):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(120)}
    for _ in range(3):  # dense crowds and chains
        x = rng.getrandbits(64)
        for _ in range(120 if hot > 3 else 25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            prints.add(x)
            prints.add(x ^ 1 << rng.randrange(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), hot=hot)
    assert {tuple(sorted(r)) for r in got.collect()} <= {tuple(sorted(p)) for p in pairs}
    want = brute_components(signed, pairs)
    found = dict(map(tuple, graph.components(got).collect()))
    assert {n: found.get(n, n) for n in signed} == want


def test_near_duplicates(spark, odd, none):
    rng = random.Random(7)
    docs = [(100 + i, t) for i, t in small()]
    for i, t in docs[:60]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append((i + 1000, " ".join(words)))
    docs += ODD + [(5000 + i, "same") for i in range(50)]
    prints = [(i, brute_print(t)) for i, t in docs]
    links = [(a, b) for a in {p for _, p in prints} for b in {p for _, p in prints} if a < b and (a ^ b).bit_count() <= 3]
    comp = brute_components({p for _, p in prints}, links)
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{p:016x}", least.get(comp[p]))) for i, p in prints)
    assert len(set(least.values())) < len(least) + 1 < len(docs)
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(odd).count() == odd.count()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3), (7, None), (3000, 2999), (2999, 3000)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "u long, v long")).collect()))
    want = brute_components(set(range(201)) | set(range(1000, 1300)) | {2999, 3000}, [x for x in links if None not in x])
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
