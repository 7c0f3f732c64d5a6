"""Sharding by best-fit-decreasing bin packing.

Equal texts form groups that are not divided. Groups are pre-aggregated by a digest; groups below a small share of the
total are bundled by hash into BUNDLES bundles, or so many that a bundle holds about 1 / PARTS of a bin, so the packing
itself sees a number of items that grows with the bins, not with the table. Items sorted by size enter the bin with the
tightest remaining capacity, found in a balanced tree. With a number of shards, a group larger than a whole bin, which
would break the law of near-equal bytes, is cut by a hash of its ids: into as many pieces as it needs bins.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Number of bundles of small groups that the driver packs, unless there are more than BUNDLES / PARTS bins.
BUNDLES = 16_384
#: A bundle is at most about this part of a bin, and so is the grain in which a group is cut.
PARTS = 64


class CapacityTree:
    """A treap over (remaining capacity, bin): insert, remove and best fit take logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None
        self._state = 0x9E3779B9

    def _priority(self) -> int:
        self._state = (self._state * 1103515245 + 12345) & 0x7FFFFFFF
        return self._state

    def _split(self, node, key):
        """(all below key, all from key on); nodes are [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key: tuple) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._priority(), None, None]), high)

    def remove(self, key: tuple) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (*key, 0))
        self.root = self._merge(low, high)

    def best_fit(self, size: int) -> tuple | None:
        """The smallest (remaining, bin) with remaining >= size."""
        node, found = self.root, None
        while node is not None:
            if node[0] >= (size,):
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found

    def largest(self) -> tuple | None:
        node = self.root
        while node is not None and node[3] is not None:
            node = node[3]
        return node and node[0]


def best_fit_decreasing(items: Iterable[tuple[Any, int]], capacity: int, bins: int | None = None) -> dict[Any, int]:
    """Bin of each item. With `bins` None, bins open as needed and an item above the capacity gets a bin of its own;
    with a number, that many are open from the start and what fits in none goes where most room is left."""
    tree, where, opened = CapacityTree(), {}, 0
    for b in range(bins or 0):
        tree.insert((capacity, b))
    for item, size in sorted(items, key=lambda x: (-x[1], str(x[0]))):
        at = tree.best_fit(size) or (tree.largest() if bins else None)
        if at is None:
            at, opened = (max(capacity, size), opened), opened + 1
        else:
            tree.remove(at)
        where[item] = at[1]
        tree.insert((at[0] - size, at[1]))
    return where


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1 (a null text: 1, CRC 0). With `shards` the capacity is an even part of all bytes;
    with `capacity` alone, as few shards as best fit gives are opened. slot numbers each shard's rows from 0 without a
    gap, in an order fixed by ids; rows repeated with one id follow each other. An empty table gives no rows."""
    if shards is None and capacity is None:
        raise ValueError("give shards or capacity")
    text = docs[text_col]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNull(), F.lit(-1)).otherwise(F.xxhash64(text, F.length(text))).alias("group"),
    )
    spark = docs.sparkSession
    # Sums per bundle are enough for most; only groups that are large by themselves are listed one by one.
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    from helixframe.llm.common import written

    groups = written(groups)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    room = capacity or max(1, -(-total // (shards or 1)))
    bundles = max(bundles, -(-total * PARTS // room))
    bundle = F.pmod(F.col("group"), F.lit(bundles))
    cut = F.ceil(F.col("bytes") / F.lit(room)).cast("long") if shards else F.lit(1).cast("long")
    large = groups.filter(F.col("bytes") > total / bundles).select("group", "bytes", cut.alias("cut"))
    listed = large.collect()  # at most `bundles` rows: each holds more than 1 / bundles of all bytes
    # A group that is cut up: the sizes of its grains are counted, as they depend on ids, and joined to even pieces.
    big = F.broadcast(large.select(F.col("group").alias("g"), "cut"))
    keyed = rows.join(big, rows["group"] == F.col("g"), "left").withColumn("piece", F.when(F.col("cut") > 1, F.pmod(F.xxhash64("doc_id"), F.col("cut") * PARTS)).otherwise(F.lit(0)).cast("long"))
    keyed = keyed.withColumn("item", F.when(F.col("g").isNotNull(), F.col("group")).otherwise(bundle)).withColumn("lone", F.col("g").isNotNull()).drop("g", "cut", "group")
    items: list[tuple[tuple, int]] = [((True, r["group"], 0), r["bytes"]) for r in listed if r["cut"] == 1]
    small = groups.join(F.broadcast(large.select("group")), "group", "left_anti").groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes"))
    items += [((False, r["b"], 0), r["bytes"]) for r in small.collect()]  # at most `bundles` rows
    piece_of, sizes = {}, {}
    if any(r["cut"] > 1 for r in listed):  # fewer than `shards` such groups exist, with fewer than 2 * shards * PARTS grains
        pieces = keyed.join(F.broadcast(large.filter("cut > 1").select(F.col("group").alias("item"))), "item", "left_semi").filter("lone").groupBy("item", "piece").agg(F.sum("size").alias("bytes"))
        whole, before = {r["group"]: r for r in listed}, {}
        for r in sorted(pieces.collect(), key=lambda r: (r["item"], r["piece"])):
            g, n, start = whole[r["item"]], r["bytes"], before.get(r["item"], 0)
            at = (True, r["item"], (2 * start + n) * g["cut"] // (2 * g["bytes"]))
            piece_of[True, r["item"], r["piece"]] = at
            sizes[at], before[r["item"]] = sizes.get(at, 0) + n, start + n
        items += sizes.items()
    where = best_fit_decreasing(items, room, shards)
    where = {k: b for k, b in where.items() if k not in sizes} | {k: where[at] for k, at in piece_of.items()}
    schema = T.StructType([T.StructField("lone", T.BooleanType()), T.StructField("item", T.LongType()), T.StructField("piece", T.LongType()), T.StructField("shard", T.IntegerType())])
    placed = spark.createDataFrame([(*k, b) for k, b in where.items()], schema)
    out = keyed.join(F.broadcast(placed), ["lone", "item", "piece"])

    # Slots: rows are dealt to small blocks by a hash of the id; a block starts where the earlier blocks of its shard end.
    blocks = max(1, groups.agg(F.sum("n")).first()[0] or 0) // 4_000 + 1
    out = out.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    counts = out.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    out = out.withColumn("rank", F.row_number().over(within)).join(starts, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
