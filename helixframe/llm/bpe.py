"""BPE encoding and decoding with a word vocabulary whose last symbol carries an end-of-word mark.

A word is split into byte symbols. For a short word a contiguous array holds the boundaries of its parts and, beside
each, the rank of the merge of that part with the next; the array is scanned for the minimum, the boundary behind it is
deleted and the two neighbouring ranks are refreshed, until no merge is left. Long words, for which the repeated scan
would be quadratic, keep the same ranks in a heap.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from helixframe.llm.common import batch_of, documents, slices

#: Words of more symbols than this go to the heap.
SHORT = 96
#: Words whose ids a worker keeps; then it starts afresh.
CACHED = 250_000
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


#: Bytes of UTF-8 of code points below U+0340, which all versions of Unicode know.
_KNOWN = bytes(range(0xCD))


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Code points that Python's Unicode tables do not know; those of other libraries, older or newer, may."""
    edges, before = [], False
    for c in range(sys.maxunicode + 2):
        now = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if now != before:
            edges.append(c)
        before = now
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z in zip(edges[::2], edges[1::2], strict=True)) + "]")


class Vocabulary:
    """Of a tokenizer file: ids, merges as ranks, and the split into words.

    Letters in lower case, composed characters and classes of code points depend on the version of Unicode. All versions
    agree on what Python's tables know; a text with other code points is normalised and split by the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.mark: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.ids[a] << 20 | self.ids[b], (rank, self.ids[a + b]))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.regular = regex.compile(split["pattern"]["Regex"]).findall
        self.odd = unassigned().search
        self.other = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.mark] for s in symbols]
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The normalised words of a text."""
        if not text.isascii() and text.encode("utf-8", "surrogatepass").translate(None, _KNOWN) and self.odd(text):
            return [word for word, _ in self.split(self.other(text))]
        return self.regular(self.normal(text))

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        return text.replace("Σ", "σ").lower()  # each letter by itself, so no final sigma

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _rank(self, a: int, b: int) -> int:
        return self.merges.get(a << 20 | b, (NONE,))[0]

    def _scan(self, parts: list[int]) -> list[int]:
        rank = self._rank
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = self.merges[parts[i] << 20 | parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i], parts[i + 1])
            if i:
                ranks[i - 1] = rank(parts[i - 1], parts[i])
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self._rank(parts[i], parts[i + 1])) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # a neighbour has changed since
            parts[i], parts[j], after[i] = self.merges[a << 20 | b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := self._rank(parts[x], parts[after[x]])) != NONE:
                    heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        known, out = self.known, []
        for piece in self.cut(text) if self.cut and "<" in text else (text,):
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
                continue
            for word in self.words(piece):
                ids = known.get(word)
                if ids is None:
                    if len(known) >= CACHED:
                        known.clear()
                    ids = array("i", self.encode_word(word)).tobytes()
                    if len(word) <= SHORT:
                        known[word] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Of this worker."""
    return Vocabulary(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, ids (array of int), decoded (string). `path` is the tokenizer file, the same
    on all machines. Null and empty texts give no ids and an empty string; special tokens in a text are recognised. Repeated
    rows are encoded each. A text of any length is encoded whole; a long one makes a batch of its own."""
    rows = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        tokens = np.array([vocab.tokens.get(i, "") for i in range(max(vocab.tokens) + 1)], dtype=object)
        for batch in slices(batches, "text"):
            raw = [vocab.encode(t) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int32)
            ids = np.frombuffer(b"".join(raw), np.int32)
            shown = tokens[ids].tolist()
            decoded = [" ".join(shown[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield batch_of(_SCHEMA, batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), decoded)

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (string) of stored ids; a null list decodes to an empty text, unknown ids are left out."""
    rows = ids.select(ids[id_col].cast("long").alias("doc_id"), F.coalesce(ids[ids_col].cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            yield batch_of(schema, batch.column("doc_id"), [vocab.decode(x) for x in batch.column("ids").to_pylist()])

    return rows.mapInArrow(run, "doc_id long, decoded string")
