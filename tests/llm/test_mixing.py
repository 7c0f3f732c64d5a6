"""Mixing against a plain reading of the rules."""

import re
from collections import defaultdict
from fractions import Fraction

import pytest
from conftest_llm import ODD, small
from helixframe.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a source's bound is shared again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left, among = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weight[s], among) for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def check(spark, rows, **more):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = brute_targets(sizes, more.get("weights", (5, 2, 1)), more.get("most_epochs", 3))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    assert sorted(str((i, words(t), s, sizes[s])) for i, t, s in rows) == sorted(str((r["doc_id"], r["size"], r["source"], r["source_size"])) for r in got)
    starts = defaultdict(list)
    for r in got:
        assert r["target"] == pytest.approx(float(target[r["source"]]), rel=1e-12)
        assert 0 <= r["taken"] <= more.get("most_epochs", 3) * r["size"]
        epochs = int(target[r["source"]]) // r["source_size"] if r["source_size"] else 0
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]
        taken[r["source"]] += r["taken"]
        starts[r["source"]].append((r["start"], r["size"]))
    for s in sizes:
        assert taken[s] == int(target[s]), s
        at = 0
        for start, size in sorted(starts[s]):  # the words of a source, without a gap
            assert start == at
            at += size
    return sorted(map(str, got))


def documents():
    rows = [(i, t, f"s{i % 5}" if i % 3 else "hot") for i, t in small()]
    return rows + [(9000 + i, "copy of a text", "copies") for i in range(400)] + [(i, t, (None, "", "ODD", "é")[k % 4]) for k, (i, t) in enumerate(ODD)]


def test_mix(spark):
    rows = documents()
    one = check(spark, rows)
    assert one == check(spark, rows[::-1]) == check(spark, rows, range_rows=20)
    assert one != check(spark, rows, seed="other")
    check(spark, rows, weights=(1,), most_epochs=2)


def test_full_sources(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(10 + i, "w " * 7, "b") for i in range(200)] + [(500, "one two", "c"), (501, None, "d"), (502, "", "e"), (None, "w " * 3000, None)]
    check(spark, rows)
    check(spark, [(1, "only a few words", "x")])
    check(spark, [(1, "", "x"), (2, None, None)])


def test_empty_and_clashing(spark, odd, none):
    assert mixing.mix(none).count() == 0
    clash = odd.withColumnsRenamed({"row_key": "key", "runs": "start"}).selectExpr("*", "1 as size", "2 as src", "3 as `range`")
    assert mixing.mix(clash).count() == odd.count()


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    rows = documents()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cols = ["doc_id", "source", "size", "source_size", "weight", "target", "budget", "start", "taken"]
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE_SQL})").fetchall()
    ours = mixing.mix(spark.createDataFrame(rows, SCHEMA)).select(*cols).collect()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in ours)
