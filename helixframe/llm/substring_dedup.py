"""Substring dedup by relative Lempel-Ziv parsing.

Documents are parsed against reference blocks of what smaller ids hold. A block is the neighbourhoods of one seed (see
seeds.py): only blocks that share a seed with a document can hold a factor of 50 words of it, and every window of 50
words lies in such a neighbourhood. A document's piece is factored greedily from left to right: at each word the block's
index is asked for the window that starts there; a hit is extended to the longest factor at that place, other words are
literals. A factor of 50 words or more is a duplicate span. Windows that straddle the end of a factor may occur
elsewhere in the block, so they are looked up one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import seeds
from helixframe.llm.common import batch_of, documents, hot_keys, join_groups, slices, with_row_key, written

WINDOW, K = 50, 8
#: Contexts of one seed that a block holds; beyond, windows are grouped one by one.
HOT = 10_000
#: What an id counts as where it is null: larger than all.
NO_ID = (1 << 63) - 1


def scheme(window: int = WINDOW) -> seeds.Scheme:
    return seeds.Scheme(window, K, seeds.word_tokens, seeds.word_grams(K))


class Block:
    """References and the index of their windows; the first reference with a window, that is the smallest id, has it."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.texts, self.index = window, [], {}

    def windows(self, words: bytes) -> list[bytes]:
        w = 8 * self.window
        return [words[i : i + w] for i in range(0, len(words) - w + 8, 8)]

    def add(self, words: bytes, windows: list[bytes]) -> None:
        at = len(self.texts)
        self.texts.append(words)
        for i, x in enumerate(windows):
            self.index.setdefault(hash(x), at << 12 | i)

    def _at(self, x: bytes) -> tuple[int, int] | None:
        found = self.index.get(hash(x))
        if found is None:
            return None
        at, i = found >> 12, 8 * (found & 4095)
        return (at, i) if self.texts[at][i : i + len(x)] == x else None

    def factors(self, words: bytes, windows: list[bytes]) -> list[tuple[int, int]]:
        """Spans of words (start, end) covered by windows of the block."""
        out, i, n = [], 0, len(words) // 8
        while i < len(windows):
            found = self._at(windows[i])
            if found is None:
                i += 1
                continue
            text, p = self.texts[found[0]], found[1]
            length = self.window
            while i + length < n and text[p + 8 * length : p + 8 * length + 8] == words[8 * (i + length) : 8 * (i + length) + 8]:
                length += 1
            out.append((i, i + length))
            end = i + length
            for j in range(end - self.window + 1, min(end, len(windows))):  # windows over the factor's end
                if self._at(windows[j]) is not None:
                    out.append((j, j + self.window))
            i = end
        return out


def _parsed(window: int):
    """Contexts sorted by seed and id: (h, c, start, end) of what smaller ids hold, relative to the seeds."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seed, last, waiting = Block(window), None, None, []
        for piece in slices(batches, "around"):
            out = []
            for h, c, least, before, words in zip(*(piece.column(x).to_pylist() for x in ("h", "c", "least", "before", "around")), strict=True):
                if h != seed:
                    block, seed, last, waiting = Block(window), h, None, []
                if least != last:  # references come from smaller ids only
                    for x in waiting:
                        block.add(*x)
                    last, waiting = least, []
                windows = block.windows(words)
                out += [(h, c, a - before, b - before) for a, b in seeds_merged(block.factors(words, windows))]
                waiting.append((words, windows))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return run


def seeds_merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return seeds.merged(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), 1 << 31) if spans else []


def _windows(window: int):
    """Every window of a context, as a hash: (s1, s2, h, c, least, back)."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("least", pa.int64()), ("back", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(window)
        for piece in slices(batches, "around", 200_000):
            out = []
            for h, c, least, before, words in zip(*(piece.column(x).to_pylist() for x in ("h", "c", "least", "before", "around")), strict=True):
                for i, x in enumerate(block.windows(words)):
                    d = xxhash.xxh3_128_digest(x)
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), h, c, least, before - i))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, start, end): spans of words covered by windows that also start in a text with a smaller id."""
    rows = with_row_key(documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    how = scheme(window)
    order = F.coalesce("doc_id", F.lit(NO_ID))
    found = seeds.repeated_seeds(rows, how, F.min(order) < F.max(order))
    of = written(found.groupBy("h", "c").agg(F.min(order).alias("least"), F.min(F.struct(order.alias("o"), "doc_id", "row_key", "pos", "before", "size")).alias("rep"), F.count("*").alias("n")))
    groups = written(of.groupBy("h").agg(F.count("*").alias("distinct")).filter("distinct > 1"))
    several = join_groups(of, groups, ["h"], hot_keys(groups, ["h"], "distinct")).withColumn("crowd", F.col("distinct") > hot)
    several = written(several.select("rep.doc_id", "rep.row_key", "rep.pos", "rep.before", "rep.size", "h", "c", "least", "crowd"))
    around = written(seeds.contexts(several.drop("crowd"), rows, how, "least"))
    crowded = several.filter("crowd").select("h").distinct()  # each has over `hot` contexts, so they are few
    few = around.join(crowded, "h", "left_anti")
    parts = max(1, around.count() // 20_000) + 11
    parsed = few.repartition(parts, "h").sortWithinPartitions("h", "least").mapInArrow(_parsed(window), "h long, c long, start int, end int")
    single = around.join(crowded, "h", "left_semi").mapInArrow(_windows(window), "s1 long, s2 long, h long, c long, least long, back int")
    first = written(single.groupBy("s1", "s2").agg(F.min("least").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    crowd = join_groups(single, first.drop("n"), ["s1", "s2"], hot_keys(first, ["s1", "s2"])).filter("first < least").select("h", "c", (-F.col("back")).alias("start"), (F.lit(window) - F.col("back")).alias("end"))
    spans = written(seeds.one_span(parsed.unionByName(crowd)))
    # A row that is not the first with its context repeats all of it; the first one repeats what was parsed.
    often = hot_keys(of, ["h", "c"])
    first_rows = join_groups(found, spans, ["h", "c"], often).select("doc_id", "row_key", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))
    later = join_groups(found, of.filter("n > 1").select("h", "c", "least"), ["h", "c"], often).filter(order > F.col("least"))
    return first_rows.unionByName(later.select("doc_id", "row_key", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") - F.col("before") + F.col("size")).alias("end")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept (the kept words joined by one space).

    A word goes if a window of `window` words of its text that covers it also starts in a text with a smaller id. A null
    id counts as larger than all ids; rows with one id never remove each other's words. Null texts have no words, texts
    shorter than the window stay. An empty table gives no rows."""
    rows = with_row_key(documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    spans = repeated_words(docs, window, hot, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc, raw, found in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
                words = raw.split()
                n = len(words)
                runs = seeds.merged(np.array([s["start"] for s in found]), np.array([s["end"] for s in found]), n) if found else []
                for a, b in reversed(runs):
                    del words[a:b]
                out.append((doc, n, n - len(words), b" ".join(words).decode()))
            yield batch_of(schema, *zip(*out, strict=True))

    return seeds.spans_of_rows(spans, rows).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

