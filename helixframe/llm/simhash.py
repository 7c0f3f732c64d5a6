"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Up to three differing bits fall on the segments so
that at least two of them differ in one bit at most (pigeonhole). The perfect Golay code (23, 12) decodes a segment to
the index of the codeword within three bits. Two segments that differ in one bit may decode differently, so a segment
has several keys: the indices of all words within one bit of it. A fingerprint is listed under the pair of its own two
indices, for each pair of segments, and probes with all pairs of its keys; whoever meets is verified by popcount.

Keys with very many fingerprints are left to a second exact way that never compares within a group: two fingerprints
within three bits have a word within two bits of one and one bit of the other, so linking, for each word, all
fingerprints within two bits to one within one bit yields the same components from a fixed number of rows each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import batch_of, slices, written
from helixframe.llm.graph import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of one key that are compared with each other; those of larger keys take the second way.
HOT = 20_000
#: Fingerprints whose keys one task makes.
DEALT = 10_000
#: Shingles whose bits are summed at once.
SUMMED = 100_000


@lru_cache(maxsize=1)
def golay_table() -> np.ndarray:
    """Index of the codeword within three bits of each 23-bit word, from the generator polynomial of the code."""
    generator = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    words = np.zeros(1, np.int32)
    for i in range(12):
        words = np.concatenate((words, words ^ np.int32(generator << i)))
    out = np.empty(1 << 23, np.int16)
    for n in range(4):
        for bits in combinations(range(23), n):
            out[words ^ np.int32(sum(1 << b for b in bits))] = np.arange(4096, dtype=np.int16)
    return out


def segment_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own index of each segment, the indices within one bit, sorted along the rows, repeats as -1)."""
    table = golay_table()
    near = np.stack([table[segment], *(table[segment ^ np.int32(1 << b)] for b in range(23))], axis=1)
    own = near[:, 0].copy()
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return own, near


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the fingerprint, whether it is listed under the key) of all keys of fingerprints (uint64)."""
    out = []
    segments = [segment_keys(((prints >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int32)) for low, n in SEGMENTS]
    for p, (a, b) in enumerate(PAIRS):
        (own_a, near_a), (own_b, near_b) = segments[a], segments[b]
        base = np.int64(p) << np.int64(24)
        out.append((base | own_a.astype(np.int64) << np.int64(12) | own_b, np.arange(len(prints)), np.ones(len(prints), bool)))
        row_a, col_a = np.nonzero(near_a >= 0)
        counts = (near_b >= 0).sum(axis=1)[row_a]
        left = np.repeat(np.arange(len(row_a)), counts)
        row_b, col_b = np.nonzero(near_b >= 0)
        first = np.concatenate(([0], np.cumsum((near_b >= 0).sum(axis=1))))[row_a]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        right = np.repeat(first, counts) + step
        key = base | near_a[row_a[left], col_a[left]].astype(np.int64) << np.int64(12) | near_b[row_b[right], col_b[right]]
        out.append((key, row_a[left], np.zeros(len(key), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fingerprint(texts: list[str]) -> list[int]:
    """The fingerprint of each text."""
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            out.append(0)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - SHINGLE + 1)
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
        votes = np.zeros(64, np.int64)
        for i in range(0, n, SUMMED):
            hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[i : i + SUMMED], stops[i : i + SUMMED], strict=True)], np.uint64)
            votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0]))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of the batches, with the fingerprint in place of the text."""
    for batch in slices(batches, "text"):
        prints = np.array(fingerprint(batch.column("text").to_pylist()), np.uint64).view(np.int64)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(prints)], names=[*kept, "print"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("print", pa.int64())])
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        for i in range(0, len(prints), 5_000):
            part = prints[i : i + 5_000]
            key, row, listed = keys_of(part.view(np.uint64))
            yield batch_of(schema, pa.array(key << np.int64(1) | ~listed), pa.array(part[row]))


def _differing(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of signed numbers it would count the absolute value


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is connected within three bits among distinct fingerprints; at most one each."""
    left, a, b = prints.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _differing(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _verified(hot: int):
    """Links within each key of rows sorted by key; (fingerprint, null) for those of a key with over `hot` rows."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def judge(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of whole groups, each with its listed rows first."""
        group = key >> 1
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        listed = np.add.reduceat((key & 1) == 0, start, dtype=np.int64)
        us, vs = [], []
        dense = (listed > 0) & (size > 64) & (listed * size > 4096)
        for s, n in zip(start[dense].tolist(), size[dense].tolist(), strict=True):
            u, v = _forest(np.unique(prints[s : s + n]))
            us.append(u)
            vs.append(v)
        plain = (listed > 0) & (size - listed > 1) & ~dense
        start, size, listed = start[plain], size[plain], listed[plain]
        pairs = listed * (size - listed)
        for i, j in _cuts(pairs, 2_000_000):
            n = pairs[i:j]
            g = np.repeat(np.arange(i, j), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            others = (size - listed)[g]
            u, v = prints[start[g] + k // others], prints[start[g] + listed[g] + k % others]
            near = (u != v) & (_differing(u ^ v) <= DISTANCE)
            us.append(u[near])
            vs.append(v[near])
        empty = np.zeros(0, np.int64)
        return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "print"))
            if passing is not None:
                n = int(np.searchsorted(k >> 1, passing, side="right"))
                yield batch_of(schema, pa.array(p[:n]), pa.nulls(n, pa.int64()))
                k, p = k[n:], p[n:]
                if not len(k):
                    continue
                passing = None
            key, prints = np.concatenate((key, k)), np.concatenate((prints, p))
            if not len(key):
                continue
            last = int(np.searchsorted(key >> 1, key[-1] >> 1))  # the last group may go on
            if last:
                yield batch_of(schema, *map(pa.array, judge(key[:last], prints[:last])))
                key, prints = key[last:], prints[last:]
            if len(key) > hot:
                passing = key[-1] >> 1
                yield batch_of(schema, pa.array(prints), pa.nulls(len(prints), pa.int64()))
                key, prints = key[:0], prints[:0]
        if len(key):
            yield batch_of(schema, *map(pa.array, judge(key, prints)))

    return run


def _cuts(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose weights add up to about `most`."""
    total = np.cumsum(weights)
    i = 0
    while i < len(weights):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _balls(bits: int):
    """All words within so many bits of each fingerprint."""
    schema = pa.schema([("word", pa.int64()), ("print", pa.int64())])
    masks = np.array([sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(64), n)], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False)
            for i in range(0, len(prints), 500):
                part = prints[i : i + 500]
                yield batch_of(schema, pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks))))

    return run


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (u, v) of distinct fingerprints in the column `print`, with the same components as all pairs within three
    bits; every link is such a pair. A fingerprint occurs in a number of rows that does not grow with its group."""
    parts = prints.count() // DEALT + 1  # a fingerprint makes some 80 rows of keys, which sizes in bytes do not tell
    keyed = prints.repartition(parts).mapInArrow(_keys, "key long, print long")
    dealt = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_verified(hot), "u long, v long").distinct())
    crowd = found.filter("v is null").select(F.col("u").alias("print"))
    centre = crowd.mapInArrow(_balls(1), "word long, print long").groupBy("word").agg(F.min("print").alias("u"))
    around = crowd.mapInArrow(_balls(2), "word long, print long").withColumnRenamed("print", "v")
    return found.filter("v is not null").unionByName(centre.join(around, "word").select("u", "v").filter("u <> v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, key: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over
    links of three differing bits or fewer).

    A null or wordless text has the fingerprint zero and is linked like any other; equal fingerprints share a component.
    Rows without an id take part in linking but never name a component, unless none of it has an id (then null).
    With `key`, a column of longs that tells rows apart, also row_key (that column) and stays: whether the row comes
    first in its component by id and key, rows without an id last. An empty table gives no rows."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *([docs[key].alias("row_key")] if key else []))
    marked = written(rows.mapInArrow(_fingerprints, "doc_id long, row_key long, print long" if key else "doc_id long, print long"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key") if key else F.lit(None)
    classes = marked.groupBy("print").agg(F.min("doc_id").alias("least"), *([F.min(order).alias("first")] if key else []))
    classes = written(classes)
    found = components(links(classes.select("print"), hot))
    # Fingerprints without a link are their own component, so only linked ones take a second step.
    joined = classes.join(found, classes["print"] == found["node"], "left").select("print", "least", *(["first"] if key else []), F.coalesce("component", "print").alias("component"))
    joined = written(joined)
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"), *([F.min("first").alias("head")] if key else []))
    names = joined.join(named, "component").select("print", "component_id", *(["head"] if key else []))
    told = [F.col("row_key"), order.eqNullSafe(F.col("head")).alias("stays")] if key else []
    return marked.join(names, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", *told)
