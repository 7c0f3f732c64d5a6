"""Language identification by a string kernel.

The kernel is a blended spectrum of presence: over byte n-grams of several lengths it counts those that two texts share,
normalised by the counts of each. Nystroem landmarks stand for the training texts: with K the kernel among landmarks, a
text x is mapped to k(x, landmarks) K^(-1/2), and one ridge regression per language is fitted on that map. Documents are
scored in batches: a presence matrix times the landmarks' gives all kernel values, times the weights all scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import slices, small_batches, text_bytes, written

#: Lengths of n-grams, in bytes; 3 at most, as a code has 24 bits.
LENGTHS = (1, 2, 3)
#: Bound of the training sample: so many texts of each language, drawn by a hash of text and language.
PER_LANGUAGE = 200
#: Most languages that are learned: those with most rows.
LANGUAGES = 256
#: Bytes of text in the sample, all languages together; each takes an even part, the smallest hashes first, but one text.
SAMPLE_BYTES = 64_000_000
#: Landmarks, or as many as there are languages if these are more.
LANDMARKS = 160
#: Numbers in the matrix of presence of one slice of documents.
SLICE_CELLS = 8_000_000
RIDGE = 0.1
NONE = "und"
#: Best score below which a text counts as one in no learned language. On sf0.01, texts with letters score 0.30 and more
#: (the lowest is a single word), symbols with one letter and scripts that were not learned below 0.15.
FLOOR = 0.2


def ngrams(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text of a slice: (text numbers, codes), sorted by both. A code holds length and bytes."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    x, out = lower[data].astype(np.uint64), []
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets)) << np.uint64(34)
    code, last = np.zeros(len(x), np.uint64), owner
    for n in range(1, max(lengths) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | x[n - 1 : n - 1 + m]
        if n in lengths:
            full = owner[:m] == last[n - 1 : n - 1 + m]
            out.append((owner[:m] | np.uint64(n << 24) | code)[full])
    found = np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)
    return (found >> np.uint64(34)).astype(np.int64), (found & np.uint64((1 << 34) - 1)).astype(np.int64)


@dataclass
class Model:
    """languages, and for n-gram codes (sorted) the matrix of their presence in landmarks, whose norms are divided out,
    with the weights of each language."""

    languages: list[str]
    codes: np.ndarray
    presence: np.ndarray
    weights: np.ndarray
    lengths: tuple[int, ...] = LENGTHS

    def kernel(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        owner, code = ngrams(data, offsets, self.lengths)
        norm = np.sqrt(np.maximum(1, np.bincount(owner, minlength=n))).astype(np.float32)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        hit = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        there = np.zeros((n, len(self.codes)), np.float32)
        there[owner[hit], at[hit]] = 1
        return there @ self.presence / norm[:, None]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.kernel(data, offsets) @ self.weights


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, lengths: tuple[int, ...] = LENGTHS) -> Model:
    """Of (text, language) rows, in any order. Landmarks are taken from the languages in turn."""
    rows = sorted(set(rows))
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 1), np.float32), np.zeros((1, 1), np.float32), lengths)
    turn: dict[str, int] = {}
    order = []
    for text, lang in rows:
        turn[lang] = turn.get(lang, -1) + 1
        order.append((turn[lang], lang, text))
    chosen = [t for _, _, t in sorted(order)[: max(landmarks, len(languages))]]
    owner, code = ngrams(*_joined(chosen), lengths)
    codes = np.unique(code)
    presence = np.zeros((len(codes), len(chosen)), np.float32)
    presence[np.searchsorted(codes, code), owner] = 1
    presence /= np.sqrt(np.maximum(1, presence.sum(axis=0)))
    model = Model(languages, codes, presence, np.zeros((len(chosen), len(languages)), np.float32), lengths)
    k_mm = model.kernel(*_joined(chosen)).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    step = max(1, min(64, SLICE_CELLS // max(1, len(codes))))
    k = np.concatenate([model.kernel(*_joined([t for t, _ in rows[i : i + step]])) for i in range(0, len(rows), step)])
    z = k.astype(np.float64) @ root
    y = np.array([[float(lang == c) for c in languages] for _, lang in rows])
    model.weights = (root @ np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)).astype(np.float32)
    return model


def training_sample(docs: DataFrame, keep: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """Of each of at most `languages` languages per_language distinct texts, or all if it has fewer, chosen by hash among
    rows where `keep` holds, the language is not null and the text has a letter. Copies of a text count once. Whole texts
    are taken, but of a language not more than its part of `sample_bytes`, so long texts make a smaller sample."""
    rows = docs.filter(keep & docs[lang_col].isNotNull() & docs[text_col].rlike(r"\p{L}")).select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    drawn = F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_003))
    # Each language's share of hashes is set to about twice its bound, by a sketch of its distinct texts.
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    below = {r["lang"]: min(1_000_003, int((2 * per_language + 50) / max(1, r["texts"]) * 1_000_003) + 1) for r in counts}
    share = F.broadcast(docs.sparkSession.createDataFrame(list(below.items()), "l string, below long"))
    some = rows.withColumn("drawn", drawn).join(share, F.col("lang") == F.col("l")).filter("drawn < below").select("lang", "drawn", "text").distinct()
    some = written(some)  # small, and read twice
    own = Window.partitionBy("lang").orderBy("drawn", "text")  # about (2 per_language + 50) texts of each language
    held = F.sum(F.octet_length("text")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    fits = lambda df: df.withColumn("held", held).withColumn("k", F.row_number().over(own)).filter((F.col("held") <= sample_bytes // len(below)) | (F.col("k") == 1))
    listed = fits(some).select("lang", "drawn", "text").collect()  # sample_bytes, or a text of each language
    by: dict[str, list] = {}
    for r in listed:
        by.setdefault(r["lang"], []).append((r["drawn"], r["text"]))
    # Where the draw falls short all the same, the smallest hashes are taken exactly.
    drawn_n = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    short = [lang for lang, b in below.items() if b < 1_000_003 and drawn_n.get(lang, 0) < per_language]
    if short:
        first = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "text"))
        least = rows.filter(F.col("lang").isin(short)).withColumn("drawn", drawn).select("lang", "drawn", "text").distinct().withColumn("k", first).filter(F.col("k") <= per_language)
        by |= {lang: [] for lang in short}
        for r in fits(least.drop("k")).collect():
            by[r["lang"]].append((r["drawn"], r["text"]))
    return [(text, lang) for lang, found in by.items() for _, text in sorted(found)[:per_language]]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), then the columns `carry`. A null text, one without letters, and every text
    under a model without languages is `und` with score 0. Ties go to the first language by name. Every row is judged for
    itself, repeated ones alike; a text counts whole, however long it is."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id__"), F.coalesce(docs[text_col], F.lit("")).alias("text__"), *(docs[c] for c in carry))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS columns of at most the n-grams of as many texts
    names = ["doc_id", "lang_pred", "score", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        for batch in slices(batches, "text__", 400_000, max(1, SLICE_CELLS // max(1, len(m.codes)))):
            texts = batch.column("text__")
            scores = m.scores(*text_bytes(texts)) if m.languages else np.zeros((len(texts), 1))
            best = scores.argmax(axis=1)
            sure = np.clip(scores[np.arange(len(best)), best], 0, 1).astype(float)
            lettered = [bool(m.languages) and _has_letter(t) for t in texts.to_pylist()]
            told = [m.languages[b] if ok else NONE for b, ok in zip(best.tolist(), lettered, strict=True)]
            arrays = [batch.column("id__"), pa.array(told, pa.string()), pa.array(np.where(lettered, sure, 0.0), pa.float64()), *(batch.column(c) for c in carry)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(docs.schema[c] for c in carry)])
    return rows.mapInArrow(run, schema)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))
