"""Seeds for finding long repeats: what two equal windows of tokens always have in common.

A window of `window` tokens holds `window - k + 1` k-grams; the one with the smallest hash is its seed. Equal windows
have equal seeds at equal offsets, so only places with a repeated seed need comparing, and a text has few seeds. The
neighbourhood of a seed, all tokens of windows that have it, is its context; as all of them hold the seed, what any
of them cover is one span. Seeds with equal contexts are
collapsed to one representative before anything is compared, which makes crowds of copies as cheap as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import batch_of, forget, hot_keys, join_groups, slices, text_bytes, written

TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
U = np.uint64


@dataclass(frozen=True)
class Scheme:
    """`tokens` turns a slice (bytes, offsets) into (tokens, offsets); `grams` hashes the k-grams of tokens."""

    window: int
    k: int
    tokens: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    grams: Callable[[np.ndarray], np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def byte_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def byte_grams(x: np.ndarray) -> np.ndarray:
    """Hashes of the 32-grams of bytes."""
    n = len(x) - 31
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(x) - 7,), np.uint64, np.ascontiguousarray(x), strides=(1,)).copy()
    eight = (eight ^ (eight >> U(29))) * U(0x9E3779B97F4A7C15)
    out = eight[:n].copy()
    for i, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        out += (eight[i : i + n] ^ (eight[i : i + n] >> U(32))) * U(c)
    return _mixed(out)


_BASE, _BYTES = U(0xD6E8FEB86659FD93), _mixed(np.arange(1, 257, dtype=np.uint64))
#: ASCII white space: what separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the first word of each text and of the end) of the words of a slice."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = offsets[(offsets > 0) & (offsets < len(data))]
    first[inside] = solid[inside]  # a word never runs on into the next text
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, from prefix sums of a polynomial."""
    starts, ends, bounds = word_bounds(data, offsets)
    power = np.full(len(data) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[1:], dtype=np.uint64)))
    inverse = np.full(len(data) + 1, U(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), bounds


def word_grams(k: int) -> Callable[[np.ndarray], np.ndarray]:
    def grams(x: np.ndarray) -> np.ndarray:
        n = len(x) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * U(0x9E3779B97F4A7C15) + x[i : i + n]
        return _mixed(out)

    return grams


def _slide(x: np.ndarray, w: int, of: np.ufunc, fill) -> np.ndarray:
    """of.reduce over each w consecutive values, from running values in blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, fill, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    up = of.accumulate(blocks, axis=1).ravel()
    down = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(down[: n - w + 1], up[w - 1 : n])


def seeds(x: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash, start, end) of the seeds of a slice; start to end are the context, what windows
    cover that have this seed. Of equal smallest hashes in a window the leftmost is its seed, so every window has one."""
    grams, w, window = scheme.grams(x), scheme.window - scheme.k + 1, scheme.window
    none = np.zeros(0, np.int64)
    if len(grams) < w:
        return none, none, np.zeros(0, np.uint64), none, none
    least = _slide(grams, w, np.minimum, TOP)
    wide = np.concatenate((np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)))
    smallest = _slide(wide, w, np.maximum, U(0)) == grams
    at = np.flatnonzero(smallest)
    # Windows that lie within one text, and the first place from each on that has the window's smallest hash.
    inside = np.zeros(len(least) + 1, np.int32)
    sizes = np.diff(offsets)
    long = sizes >= window
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    chosen = np.searchsorted(at, starts) if len(starts) * 8 < len(least) else (np.cumsum(smallest) - smallest)[starts]
    wrong = np.flatnonzero(grams[at[chosen]] != least[starts])
    while len(wrong):
        chosen[wrong] += 1
        wrong = wrong[grams[at[chosen[wrong]]] != least[starts[wrong]]]
    if not len(starts):
        return none, none, np.zeros(0, np.uint64), none, none
    text = np.searchsorted(offsets, starts, side="right") - 1
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    pos = at[chosen[first]]
    return text[first], pos, grams[pos], starts[first], starts[last] + window


def context_id(around: np.ndarray, before: int) -> int:
    return xxhash.xxh3_64_intdigest(around.tobytes(), before)


def find_seeds(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, row_key, pos, before, size, h, c) of all seeds: position in tokens, tokens of the context before it and
    in all, hashes of the seed and of its context."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("size", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            x, offsets = scheme.tokens(*text_bytes(batch.column("text")))
            text, at, h, start, end = seeds(x, offsets, scheme)
            c = [context_id(x[a:b], p - a) for a, b, p in zip(start.tolist(), end.tolist(), at.tolist(), strict=True)]
            own = pa.array(text)
            ints = [pa.array(v.astype(np.int32)) for v in (at - offsets[text], at - start, end - start)]
            yield batch_of(schema, batch.column("doc_id").take(own), batch.column("row_key").take(own), *ints, pa.array(h.view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)))

    return rows.mapInArrow(run, "doc_id long, row_key long, pos int, before int, size int, h long, c long")


def repeated_seeds(rows: DataFrame, scheme: Scheme, repeated: Column) -> DataFrame:
    """Of find_seeds(), those whose hash satisfies `repeated`, an aggregate over its rows; a written table."""
    found = written(find_seeds(rows, scheme))
    twice = written(found.groupBy("h").agg(repeated.alias("yes"), F.count("*").alias("n")).filter("yes").drop("yes"))
    out = written(join_groups(found, twice.select("h"), ["h"], hot_keys(twice, ["h"])))
    forget(found)
    forget(twice)
    return out


def contexts(reps: DataFrame, rows: DataFrame, scheme: Scheme, carry: str) -> DataFrame:
    """Adds the contexts to representatives (doc_id, row_key, pos, before, size, h, c and the long column `carry`): (h, c, carry,
    before, around), around being the bytes of the tokens and before how many come before the seed. Texts that are
    needed are joined once, with all their representatives; a repeated row gives its contexts again."""
    asked = reps.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_list(F.struct("pos", "before", "size", "h", "c", carry)).alias("asked"))
    joined = rows.join(asked, (rows["row_key"] == F.col("k")) & rows["doc_id"].eqNullSafe(F.col("d"))).select("text", "asked")
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), (carry, pa.int64()), ("before", pa.int32()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            x, offsets = scheme.tokens(*text_bytes(batch.column("text")))
            asked = batch.column("asked")
            flat = asked.flatten()
            owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            pos, before, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("pos", "before", "size"))
            start = offsets[owner] + pos - before
            around = [x[a : a + n].tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            yield batch_of(schema, flat.field("h"), flat.field("c"), flat.field(carry), flat.field("before"), around)

    return joined.mapInArrow(run, f"h long, c long, {carry} long, before int, around binary")


def one_span(spans: DataFrame) -> DataFrame:
    """One row (h, c, start, end) per context: all its spans hold the seed, so their union is one span."""
    return spans.groupBy("h", "c").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def spans_of_rows(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, row_key, text) with the array of all their spans (start, end); null where there are none."""
    by = spans.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(by, (rows["row_key"] == F.col("k")) & rows["doc_id"].eqNullSafe(F.col("d")), "left").select("doc_id", "text", "spans")


def merged(starts: np.ndarray, ends: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans, clipped to 0 to n."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(np.maximum(starts[order], 0).tolist(), np.minimum(ends[order], n).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]
