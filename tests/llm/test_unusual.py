"""Repetitive and very long texts, and all code points."""

import random
import sys
import time

import pytest
from conftest_llm import small
from helixframe.llm import bpe, decontaminate, queries
from test_scans import brute_contamination


def test_code_points_as_the_tokenizers_library():
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(queries.tokenizer_path()), bpe.Vocabulary(queries.tokenizer_path())
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 200):  # each between letters, digits and signs
        text = " ".join(f"a{chr(c)}1{chr(c)}!{chr(c)}" for c in points[k : k + 200])
        assert memoryview(mine.encode(text)).cast("i").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(points[k])
    rng = random.Random(6)
    new = [chr(c) for a, z in ((0x1C89, 0x1C8B), (0xA7CB, 0xA7DD), (0x10D40, 0x10D90), (0x16D40, 0x16D7A), (0x11380, 0x113E3), (0x16100, 0x1613A), (0x16EA0, 0x16ED4)) for c in range(a, z)] + list("aé ẹ́ 1")
    for _ in range(2000):  # what composes and is reordered
        t = "".join(rng.choices(new, k=12))
        assert memoryview(mine.encode(t)).cast("i").tolist() == lib.encode(t, add_special_tokens=False).ids, t.encode("unicode_escape")


def test_repetitive_items(spark):
    rng = random.Random(3)
    phrase = "a b c d e f g "
    items = [(1, "word " * 3000), (2, phrase * 200), (3, "word " * 3000), (4, "word"), (5, " ".join(rng.choices("xy", k=600))), (6, phrase * 2), (7, "word other " * 12)]
    docs = [(1, "word " * 40 + "stop " + "word " * 12), (2, phrase * 3 + "z " + phrase), (3, " ".join(rng.choices("xy", k=900))), (4, "Word OTHER " * 8), (5, "nothing here"), (6, "word " * 12), (7, phrase.upper() * 2)]
    tests = decontaminate.Items([(str(i), t) for i, t in items])
    want = {d: (n, hit, ids) for d, n, hit, ids, _, _ in brute_contamination(docs, items)}
    for d, t in docs:
        n, runs, spans, found = decontaminate.scan(t, tests)
        assert (n, sum(b - a for a, b in runs), len(found)) == want[d], d
    took = []
    for n in (50_000, 200_000):
        start = time.process_time()
        assert decontaminate.scan("word " * n, tests)[1] == [(0, n)]
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.5  # in proportion


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_long_texts_and_clashing_columns(spark, block_bytes):
    rng = random.Random(4)
    base = [t for _, t in small(60) if t]
    long = " ".join(rng.choices(base, k=2500))  # several MB
    assert len(long) > 3_000_000
    docs = [(1, long), (2, "short"), (2, "short"), (None, base[0])]
    items = [(None, base[0][:300]), (None, base[1][:200]), (3, base[2][:300])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, runs int, row_key int")
    bench = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id long, text string, doc_id int, item string, row_key int")
    got = decontaminate.find_contamination(df, bench, block_bytes=block_bytes).collect()
    want = brute_contamination(docs, [("" if i is None else i, t) for i, t in items])
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]))) for r in got) == sorted(str(w[:4]) for w in want)
    vocabulary = bpe.Vocabulary(queries.tokenizer_path())
    parts = [vocabulary.encode(t + " ") for t in base[:3]]
    assert vocabulary.encode(" ".join(base[:3]) + " ") == b"".join(parts)
