"""Benchmark decontamination: one Aho-Corasick automaton over the normalised texts of all test items.

The automaton holds each item as consecutive blocks of words, half a window long: every window of an item holds one of
them whole, so a document with a window meets a block. Every document is normalised (A-Z lower-cased, cut into words) and
scanned once, word by word. Around the blocks that are met, each place of the document is looked up among the windows of
the items, by hash and then word by word. Hits are mapped back to code points of the original text. An item shorter than a
window is one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import batch_of, slices, with_row_key, written

WINDOW = 13
#: Bytes of item texts in one automaton, which takes some 40 times as many in each Python worker. Larger item tables are
#: scanned in as many passes.
BLOCK_BYTES = 8_000_000

#: Bytes that separate words become spaces, A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
_DDL = "doc_id long, row_key long, n_words long, runs array<struct<start: long, end: long>>, spans array<struct<start: int, end: int>>, items array<string>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Items:
    """The automaton over the blocks of (item_id, text), and the windows of the items by hash.

    Words are numbers, and the automaton's letters are words. Where a block ends in a document, the windows that hold it are
    looked up: their hashes in a sorted array, their words beside those of the item, so that every place of a document is
    looked up once, however often blocks and items repeat."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window, block = window, (window + 1) // 2
        texts: dict[bytes, set[str]] = {}
        for name, text in items:
            texts.setdefault(b" ".join(words(text)), set()).add(name)
        texts.pop(b"", None)
        self.number: dict[bytes, int] = {}
        self.names = [sorted(x) for x in texts.values()]
        keys: dict[tuple[int, ...], list[int]] = {}
        flat, first, owner, at = [], [], [], 0
        for k, text in enumerate(texts):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in text.split()]
            if len(w) < window:
                keys.setdefault(tuple(w), []).append(k)
                continue
            for i in range(0, len(w) - block + 1, block):
                keys.setdefault(tuple(w[i : i + block]), [])
            flat += w
            starts = np.arange(at, at + len(w) - window + 1)
            first.append(starts)
            owner.append(np.full(len(starts), k))
            at += len(w)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, own in keys.items():
            self.auto.add_word(key, (len(key), own, len(key) == block))
        self.empty = not keys
        if keys:
            self.auto.make_automaton()
        self.flat = np.array(flat, np.int64)
        first, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, owner))
        rng = np.random.default_rng(0)
        while True:  # until windows with equal hashes are equal
            self.factors = rng.integers(1, 1 << 63, window, np.uint64) * 2 + 1
            hashes = self._hashes(self.flat, first)
            self.hashes, place, of = np.unique(hashes, return_index=True, return_inverse=True)
            self.place = first[place]
            if all((self.flat[first + j] == self.flat[self.place[of] + j]).all() for j in range(window)):
                break
        pairs = np.unique(np.stack([of, owner]), axis=1)
        self.owners, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.hashes) + 1))

    def _hashes(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for j in range(self.window):
            x = numbers[starts + j].astype(np.uint64)
            out += (x ^ (x << np.uint64(21))) * self.factors[j]
        return out

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(runs of words in windows, items hit) of the words of a text."""
        get = self.number.get
        numbers = tuple([get(x, 0) for x in w])
        ends, edge, found = [], np.zeros(len(w) + 1, np.int64), set()
        for end, (n, own, block) in self.auto.iter(numbers):
            if own:
                edge[end + 1 - n] += 1
                edge[end + 1] -= 1
                found.update(own)
            if block:
                ends.append(end)
        if ends:
            ends, window = np.array(ends), self.window
            near = np.zeros(len(w) + 1, np.int64)
            np.add.at(near, np.maximum(ends - window + 1, 0), 1)
            np.add.at(near, ends - (window + 1) // 2 + 2, -1)
            starts = np.flatnonzero(np.cumsum(near)[: max(0, len(w) - window + 1)] > 0)
            numbers = np.array(numbers, np.int64)
            hashes = self._hashes(numbers, starts)
            of = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
            same = self.hashes[of] == hashes
            starts, of = starts[same], of[same]
            for j in range(window):
                same = numbers[starts + j] == self.flat[self.place[of] + j]
                starts, of = starts[same], of[same]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            for k in np.unique(of).tolist():
                found.update(self.owners[self.first[k] : self.first[k + 1]].tolist())
        covered = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
        runs = list(zip(np.flatnonzero(covered == 1).tolist(), np.flatnonzero(covered == -1).tolist(), strict=True))
        return runs, {name for k in found for name in self.names[k]}


#: The automaton that a Python worker used last, by the table it was made for.
_LAST: dict[str, Items] = {}


def _items(token: str, listed, window: int) -> Items:
    if token not in _LAST:
        _LAST.clear()
        _LAST[token] = Items(listed.value, window)
    return _LAST[token]


def scan(text: str, tests: Items | None) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[str]]:
    """(number of words, hit runs of words, the same as code points of `text`, items hit)."""
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.translate(_TABLE).split()
    if tests is None or tests.empty or not w:
        return len(w), [], [], set()
    runs, items = tests.hits(w)
    if not runs:
        return len(w), [], [], set()
    kept = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], kept.view(np.int8), [0])))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return len(w), runs, [(int(points[first[a]]), int(points[after[b - 1]])) for a, b in runs], items


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, key: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, items (sorted ids as strings), spans (start, end: code points
    of hit runs in the original text; runs of items in different blocks may overlap).

    A window is `window` consecutive words of an item, or all words of a shorter one. Null or wordless texts have no
    words and no hits; items without words give no window; an item with a null id is named by the empty string. Repeated
    items count once, and repeated documents are judged each. Item texts travel in blocks of at most `block_bytes`, one automaton a block, kept by a worker from
    task to task. Texts of any length are scanned whole, one at a time if they are long. With
    `key`, a column of longs that tells rows apart, that column comes last, as row_key."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *([docs[key].alias("row_key")] if key else []))
    rows, told = (rows, ["row_key"]) if key else (with_row_key(rows), [])
    tests = items.select(F.coalesce(items[item_id_col].cast("string"), F.lit("")).alias("item"), F.coalesce(items[item_text_col], F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    parts = []
    for b in range(blocks):
        mine = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        listed = docs.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in mine.collect()])  # block_bytes, about
        parts.append(rows.mapInArrow(_scanner(listed, window, all_rows=blocks == 1), _DDL))
    if blocks == 1:
        return parts[0].select("doc_id", "n_words", _covered("runs").alias("n_hit"), F.array_sort("items").alias("items"), "spans", *told)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    one = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    hits = written(hits).groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(*(one(c).alias(c) for c in ("runs", "spans", "items")))
    counted = rows.mapInArrow(_scanner(None, window, all_rows=True), _DDL).select("doc_id", "row_key", "n_words")
    joined = counted.join(hits, (F.col("row_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select("doc_id", "n_words", F.coalesce(_covered("runs"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"), *told)


def _covered(runs: str):
    """Words in any of the runs, which may overlap."""
    return F.expr(f"cast(size(array_distinct(flatten(transform({runs}, r -> sequence(r.start, r.end - 1))))) as bigint)")


def _dicts(pairs: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": b} for a, b in pairs]


def _scanner(listed, window: int, all_rows: bool):
    """Scans Arrow batches of (doc_id, text, row_key); with all_rows False, rows without a hit are left out."""

    token = uuid.uuid4().hex

    def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _items(token, listed, window) if listed is not None else None
        for batch in slices(batches, "text"):
            out = []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n, runs, spans, items = scan(text, tests)
                if all_rows or runs:
                    out.append((doc, key, n, _dicts(runs), _dicts(spans), list(items)))
            if out:
                yield batch_of(_SCHEMA, *zip(*out, strict=True))

    return scanner
