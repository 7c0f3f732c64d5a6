"""Suffix-array dedup with a logarithmic family of indexes.

Seeds (see seeds.py) stand for the suffixes that start at them: any two equal 400-byte strings share a seed, so it is
enough to index the suffixes at seeds, cut to the window, each with the bytes before it. The suffix space is dealt to
tasks by the hash of the seed, and every task keeps a logarithmic family: a new batch gets a suffix array and joins the
levels like a binary counter. Whenever two arrays of equal size meet they are merge-scanned: neighbours' longest common
prefixes to the right, and suffixes to the left, mark the strings that occur in more than one place. In the end the
remaining levels are merged, so each pair of suffixes has met in one scan.

A seed with more distinct contexts than a task should hold is left out of the family and judged string by string in
grouped rows, which is exact too and spreads over all tasks.
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

WINDOW, K = 400, 32
#: Suffixes of a new batch, the smallest level.
BATCH = 4_096
#: Contexts of one seed that the family holds; beyond, strings are grouped one by one.
HOT = 30_000


def scheme(window: int = WINDOW) -> seeds.Scheme:
    return seeds.Scheme(window, K, seeds.byte_tokens, seeds.byte_grams)


def _common(x: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row of fixed-length byte strings with the row before; 0 for the first."""
    width = x.dtype.itemsize
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), width)
    out = np.zeros(len(x), np.int32)
    for i in range(1, len(x), 8_192):
        differ = rows[i : i + 8_192] != rows[i - 1 : i - 1 + len(rows[i : i + 8_192])]
        first = differ.argmax(axis=1)
        out[i : i + 8_192] = np.where(differ[np.arange(len(first)), first], first, width)
    return out


class Family:
    """Levels of sorted suffixes. A suffix is its number; `right` holds the bytes from the seed on, `left` those before
    it in reverse, both padded; their true lengths beside. marks[i, o] says that the window starting o bytes before
    seed i occurs elsewhere."""

    def __init__(self, window: int = WINDOW, batch: int = BATCH) -> None:
        self.window, self.left_len, self.batch = window, window - K, batch
        self.right = np.zeros(0, f"S{window}")
        self.left = np.zeros(0, f"S{self.left_len}")
        self.right_n = self.left_n = np.zeros(0, np.int32)
        self.marks = np.zeros((0, self.left_len + 1), bool)
        self.levels: dict[int, np.ndarray] = {}

    def add(self, around: list[bytes], before: np.ndarray) -> None:
        """A batch of contexts."""
        base, w = len(self.right), self.window
        self.right = np.concatenate((self.right, np.array([a[b : b + w] for a, b in zip(around, before.tolist(), strict=True)], f"S{w}")))
        self.left = np.concatenate((self.left, np.array([a[:b][::-1] for a, b in zip(around, before.tolist(), strict=True)], f"S{self.left_len}")))
        self.left_n = np.concatenate((self.left_n, before.astype(np.int32)))
        self.right_n = np.concatenate((self.right_n, np.array([len(a) for a in around], np.int32) - before))
        self.marks = np.concatenate((self.marks, np.zeros((len(around), self.left_len + 1), bool)))
        self._carry(self._scanned(np.arange(base, len(self.right))))

    def _carry(self, array: np.ndarray) -> None:
        level = max(0, (max(1, len(array)) - 1) // self.batch).bit_length()
        while level in self.levels:
            array = self._scanned(np.concatenate((self.levels.pop(level), array)))
            level += 1
        self.levels[level] = array

    def close(self) -> None:
        """Merges what levels are left, the smallest first."""
        while len(self.levels) > 1:
            a, b = sorted(self.levels)[:2]
            self.levels[b] = self._scanned(np.concatenate((self.levels.pop(a), self.levels.pop(b))))

    def _scanned(self, some: np.ndarray) -> np.ndarray:
        """The suffix array of the given suffixes, sorted runs being merged; marks windows that occur twice in it."""
        order = some[np.argsort(self.right[some], kind="stable")]
        n = len(order)
        if n < 2:
            return order
        up = _common(self.right[order])
        by_left = np.argsort(self.left[order], kind="stable")
        up_left = _common(self.left[order][by_left])
        near = np.maximum(up, np.append(up[1:], 0))
        near_left = np.empty(n, np.int32)
        near_left[by_left] = np.maximum(up_left, np.append(up_left[1:], 0))
        rank = np.empty(n, np.int64)
        rank[by_left] = np.arange(n)
        # Offsets at which a suffix can have a partner at all.
        least = self.window - np.minimum(near, self.right_n[order])
        most = np.minimum(near_left, self.left_n[order])
        live = np.flatnonzero(least <= most)
        for o in range(self.left_len + 1):
            here = live[(least[live] <= o) & (most[live] >= o)]
            if len(here) < 2:
                continue
            right_group = np.cumsum(up < self.window - o)[here]
            left_group = np.cumsum(up_left < o)[rank[here]] if o else 0
            key = right_group * np.int64(n + 1) + left_group
            sort = np.argsort(key, kind="stable")
            same = key[sort][1:] == key[sort][:-1]
            twice = np.zeros(len(here), bool)
            twice[sort[1:][same]] = True
            twice[sort[:-1][same]] = True
            self.marks[order[here[twice]], o] = True
        return order

    def spans(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, start, end) relative to the seeds, of what marked windows of suffixes i to j cover: one span each,
        since every window holds the seed."""
        marks = self.marks[i:j]
        row = np.flatnonzero(marks.any(axis=1))
        first, last = marks[row].argmax(axis=1), self.left_len - marks[row][:, ::-1].argmax(axis=1)
        return row + i, -last, self.window - first


def _judged(window: int, batch: int):
    """Per task: contexts of all its seeds go through one family of levels; (h, c, start, end) come out."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, h, c = Family(window, batch), [], []

        def closed() -> Iterator[pa.RecordBatch]:
            family.close()
            hs, cs = np.concatenate(h), np.concatenate(c)
            for i in range(0, len(hs), 16_384):
                row, start, end = family.spans(i, min(len(hs), i + 16_384))
                yield batch_of(schema, pa.array(hs[row]), pa.array(cs[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)))

        held = 0
        for piece in slices(batches, "around", batch * 700):
            hs = piece.column("h").to_numpy(zero_copy_only=False)
            # Sorted by h, so a family can be closed where h changes: seeds of different hashes need not meet.
            if held > 8 * batch and hs[0] != h[-1][-1]:
                yield from closed()
                family, h, c, held = Family(window, batch), [], [], 0
            h.append(hs)
            c.append(piece.column("c").to_numpy(zero_copy_only=False))
            family.add(piece.column("around").to_pylist(), piece.column("before").to_numpy(zero_copy_only=False))
            held += len(hs)
        if h:
            yield from closed()

    return run


def _strings(window: int):
    """Every window of a context, as a hash: (s1, s2, h, c, back)."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("back", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "around", 100_000):
            out = []
            for h, c, before, around in zip(*(piece.column(x).to_pylist() for x in ("h", "c", "before", "around")), strict=True):
                for o in range(max(0, window - (len(around) - before)), min(before, window - K) + 1):
                    d = xxhash.xxh3_128_digest(around[before - o : before - o + window])
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), h, c, o))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return run


def repeated_bytes(docs: DataFrame, window: int = WINDOW, batch: int = BATCH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, start, end): spans of bytes covered by strings of `window` bytes that also start elsewhere."""
    rows = with_row_key(documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    how = scheme(window)
    found = seeds.repeated_seeds(rows, how, F.count("*") > 1)
    of = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row_key", "pos", "before", "size")).alias("rep"))
    of = written(of)
    groups = written(of.groupBy("h").agg(F.count("*").alias("distinct")).filter("distinct > 1"))
    several = written(join_groups(of, groups, ["h"], hot_keys(groups, ["h"], "distinct")).select("rep.*", "h", "c", "distinct"))
    around = seeds.contexts(several, rows, how, "distinct")
    around = written(around)
    # Whole contexts that occur twice are covered from end to end.
    whole = of.filter("n > 1").select("h", "c", (-F.col("rep.before")).alias("start"), (F.col("rep.size") - F.col("rep.before")).alias("end"))
    few = around.filter(F.col("distinct") <= hot)
    parts = max(1, few.count() // 20_000) + 11
    judged = few.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_judged(window, batch), "h long, c long, start int, end int")
    strings = around.filter(F.col("distinct") > hot).mapInArrow(_strings(window), "s1 long, s2 long, h long, c long, back int")
    same = ["s1", "s2", "h", "back"]
    twice = written(strings.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1"))
    crowd = join_groups(strings, twice.drop("n"), same, hot_keys(twice, same)).select("h", "c", (-F.col("back")).alias("start"), (F.lit(window) - F.col("back")).alias("end"))
    spans = written(seeds.one_span(whole.unionByName(judged).unionByName(crowd)))
    spread = join_groups(found, spans, ["h", "c"], hot_keys(of, ["h", "c"]))
    return spread.select("doc_id", "row_key", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, batch: int = BATCH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Every byte covered by a string of `window` bytes that also starts anywhere else, the same text included, goes.
    Null texts count as empty, texts shorter than the window stay whole, repeated rows remove each other's bytes. The
    kept bytes need not be valid UTF-8. An empty table gives no rows."""
    rows = with_row_key(documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    spans = repeated_bytes(docs, window, batch, hot, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            for doc, raw, found in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist(), strict=True):
                runs = seeds.merged(np.array([s["start"] for s in found]), np.array([s["end"] for s in found]), len(raw)) if found else []
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), b"".join([*kept, raw[at:]])))
            yield batch_of(schema, *zip(*out, strict=True))

    return seeds.spans_of_rows(spans, rows).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

