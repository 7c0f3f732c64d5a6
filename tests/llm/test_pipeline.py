"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline as cp
from helixframe.llm import queries
from test_lines import brute as brute_lines
from test_scans import brute_contamination
from test_simhash import brute_components, brute_print

AT = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = queries.table(spark, AT, "documents")
    extra = [(100_000, None, None, None, None), (100_001, "123 !!", "en", "s", 6), (100_002, "", "en", "s", 0), (100_003, "ends with letters of a text", None, None, 5)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    made = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, AT).collect(), stage(spark, before, AT).schema)
        made[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
        if name != cp.STAGES[-1][0]:
            assert docs.columns == list(cp.COLUMNS)

    before, after = made["language ID"]
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[1] and any(map(str.isalpha, r[1])))
    before, after = made["line dedup"]
    want = {i: t for i, t, _, n in brute_lines([(r[0], r[1]) for r in before]) if not n or t.strip()}
    assert {r[0]: r[1] for r in after} == want and len(want) < len(before)
    assert all(r[4] == len(r[1]) for r in after)
    assert {r[0]: r[2:4] for r in after}.items() <= {r[0]: r[2:4] for r in before}.items()
    before, after = made["SimHash near-dedup"]
    prints = {r[0]: brute_print(r[1]) for r in before}
    kinds = set(prints.values())
    comp = brute_components(kinds, [(a, b) for a in kinds for b in kinds if a < b and (a ^ b).bit_count() <= 3])
    assert {r[0] for r in after} == {min(i for i, p in prints.items() if comp[p] == c) for c in set(comp.values())}
    before, after = made["benchmark decontamination"]
    items = [tuple(r) for r in queries.table(spark, AT, "benchmark").select("item_id", "text").collect()]
    assert {r[0] for r in after} == {x[0] for x in brute_contamination([(r[0], r[1]) for r in before], items) if not x[5]}
    before, after = made["BPE encoding and decoding"]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path())
    want = {r[0]: lib.encode(r[1], add_special_tokens=False).ids for r in before}
    assert {r[0]: list(r[2]) for r in after} == want
    assert all(r[3] == lib.decode(want[r[0]], skip_special_tokens=False) and r[1] == len(want[r[0]]) for r in after)


def test_run(spark):
    got = cp.run(spark, AT)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 50
