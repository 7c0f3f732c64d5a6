"""The language classifier against a dense kernel ridge regression, and the bounds of its sample."""

import numpy as np
from conftest_llm import small

from helixframe.llm import langid
from pyspark.sql import functions as F


def grams(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return {raw[i : i + n] for n in langid.LENGTHS for i in range(len(raw) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])


def test_scores_are_those_of_dense_ridge_regression(spark):
    docs = [(i, t) for i, t in small(160) if t and any(map(str.isalpha, t))]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()
    lang = {r["doc_id"]: r["lang"] for r in rows}
    train = sorted({(t[:400], lang[i]) for i, t in docs[:80] if lang[i]})
    model = langid.fit(train, landmarks=len(train), ridge=0.1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    # With every training text as a landmark the map is exact, so ridge on it is ridge with the kernel.
    own = [grams(t) for t, _ in train]
    k = kernel(own, own)
    names = sorted({x for _, x in train})
    y = np.array([[float(x == n) for n in names] for _, x in train])
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values.max()
    dual = vectors[:, good] @ ((vectors[:, good].T @ y) / (values[good] + 0.1)[:, None])
    for i, t in docs:
        s = kernel([grams(t)], own) @ dual
        assert got[i][0] == names[int(s[0].argmax())] or np.sort(s[0])[-1] - np.sort(s[0])[-2] < 1e-3
        assert abs(got[i][1] - min(1, max(0, s[0].max()))) < 5e-3


def test_sample_is_bounded_by_bytes(spark):
    rows = [(i, f"text number {i} " * 50, "a") for i in range(100)] + [(1000, "one long text " * 5000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.training_sample(df, F.lit(True), sample_bytes=20_000)
    assert {x for _, x in found} == {"a", "b"}
    assert 5 <= sum(x == "a" for _, x in found) <= 14  # some 700 bytes each, of 10,000 a language
