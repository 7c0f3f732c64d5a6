"""Stages of the pipeline judge rows, not ids: null and repeated ids."""

import corpus_pipeline as cp
from helixframe.llm import langid, queries
from test_pipeline import AT

TEXTS = [
    "a garden path leads down to the river where boats wait for the morning tide",
    "seven engineers measured the bridge twice and wrote their numbers in a small book",
    "winter came early that year and the harvest stood under snow until the end of march",
    "nobody in the village could remember who had painted the door of the mill green",
]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_dedup_by_row(spark):
    a, b, c, d = TEXTS
    # b shares its id with a, c has no id, and of d one copy has an id. Each text stays exactly once.
    docs = rows_of(spark, [(1, a, "s"), (1, b, "s"), (None, c, "s"), (None, c, "s"), (None, c, "t"), (None, d, "s"), (7, d, "s"), (7, d, "s"), (9, a, "s")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.near_dedup(spark, docs, AT).collect())
    assert got == sorted([("1", a), ("1", b), ("None", c), ("7", d)])
    again = cp.near_dedup(spark, docs.repartition(7), AT).collect()
    assert sorted(map(str, again)) == sorted(map(str, cp.near_dedup(spark, docs, AT).collect()))


def test_decontamination_by_row(spark):
    item = queries.table(spark, AT, "benchmark").select("text").first()[0]
    docs = rows_of(spark, [(None, item, "s"), (None, TEXTS[0], "s"), (None, TEXTS[1], "s"), (3, item, "s"), (3, TEXTS[2], "s"), (4, TEXTS[3], "s")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.decontaminated(spark, docs, AT).collect())
    assert got == sorted([("None", TEXTS[0]), ("None", TEXTS[1]), ("3", TEXTS[2]), ("4", TEXTS[3])])


def test_training_sample_counts_distinct_texts(spark):
    few = [f"texto {k} de una lengua con copias" for k in range(40)]
    rows = [(i, few[i % 40], "es") for i in range(4000)] + [(5000 + i, f"a text of its own {i}", "en") for i in range(300)] + [(6000 + i, None if i % 2 else "12 !", "fr") for i in range(500)] + [(7000, "une phrase", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(docs, docs["doc_id"] >= 0, per_language=30)
    by = {lang: {t for t, g in got if g == lang} for lang in ("es", "en", "fr")}
    assert {k: len(v) for k, v in by.items()} == {"es": 30, "en": 30, "fr": 1} and len(got) == 61 and by["es"] <= set(few)


def test_language_id_rejects_by_score(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    odd = ["$$$ 12 %% ## a 44 !! ==", "{}[];:<>()" * 20 + "e", "0123 4567 89 " * 30 + "q", "Это русский текст о погоде", "漢字仮名交じり文はここにある", "Η γρήγορη αλεπού πηδάει"]
    extra = spark.createDataFrame([(1_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    got = {r[0] for r in cp.language_id(spark, docs.unionByName(extra), AT).select("doc_id").collect()}
    assert not {i for i in got if i >= 1_000_000}
    clean = {r[0] for r in docs.filter(queries.held_out() & docs["text"].rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(clean) > 150 and clean <= got
