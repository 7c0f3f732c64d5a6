"""Removal of long repeats, by bytes and by words, against brute force."""

import random
from collections import Counter

import pytest
from conftest_llm import ODD, small
from helixframe.llm import substring_dedup, suffix_dedup


def planted():
    """Small documents with copies, shared passages, runs, periods and repeats within one text."""
    rng = random.Random(8)
    docs = [(100 + i, t) for i, t in small(120)]
    texts = [t for _, t in docs if len(t) > 1500]
    passage = texts[0][:900]
    for i in range(40):
        t = rng.choice(texts)
        a, b = rng.randrange(len(t)), rng.randrange(len(t))
        docs.append((1000 + rng.randrange(500), t[min(a, b) : max(a, b)] + rng.choice(texts)[:300] + passage[rng.randrange(300) : rng.randrange(500, 900)] + str(i)))
    docs += [(2000 + i, f"{i} {passage} {i}") for i in range(30)]
    docs += [(3000, "a" * 1200), (3001, "x" + "a" * 401), (3002, "a" * 400), (3003, "ab " * 500), (3004, "\x00" * 450 + "q"), (3005, "\x00" * 401), (3006, "p q " * 200), (3007, "é" * 250), (2999, " ".join(str(i % 60) for i in range(300)))]
    return docs + ODD


def brute_bytes(docs, window):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + window] for _, b in raw for k in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\x01" * window
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def brute_words(docs, window):
    split = [(i, tuple((t or "").encode().split())) for i, t in docs]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            x = w[k : k + window]
            first[x] = min(order(i), first.get(x, float("inf")))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[w[k : k + window]] < order(i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("batch, hot", [(4096, 30_000), (16, 30_000), (64, 4)])
def test_suffix_dedup(spark, batch, hot):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, batch=batch, hot=hot).collect()
    want = brute_bytes(docs, 400)
    assert sum(x[2] for x in want) > 20_000
    assert sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == sorted(map(str, want))


@pytest.mark.parametrize("hot", [10_000, 3])
def test_substring_dedup(spark, hot):
    docs = planted()
    got = substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()
    want = brute_words(docs, 50)
    assert sum(x[2] for x in want) > 3000
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_and_empty_tables(odd, none):
    for f in (suffix_dedup.remove_repeats, substring_dedup.remove_repeats):
        assert f(none).count() == 0 and f(odd).count() == odd.count()


def test_factors_over_boundaries():
    block = substring_dedup.Block(4)
    say = lambda *w: b"".join(x.to_bytes(8, "little") for x in w)
    for ref in (say(1, 2, 3, 4, 5), say(3, 4, 5, 6, 7)):
        block.add(ref, block.windows(ref))
    text = say(9, 1, 2, 3, 4, 5, 6, 7, 9)
    assert set(block.factors(text, block.windows(text))) >= {(1, 6), (3, 7), (4, 8)}
