"""Bloom filters as small tables of bits, in DataFrame functions only.

A filter is a table of lanes, each an array of 64-bit words. Its size follows the number of keys, SHARE bits each, up to
MOST bits, which bound what is broadcast. Beyond, more keys only make more false hits; users of a filter follow it with
an exact step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for a key; 2 slots each leave about one key in 70 with a false hit in a filter of repeats.
SHARE = 16
#: 2**30 bits are 128 MB, enough for 67 million keys at SHARE.
LEAST, MOST = 1 << 16, 1 << 30
#: Words of one lane.
WORDS = 512
LANE = WORDS * 64


def bits_for(keys: int) -> int:
    """Size of a filter for so many keys, a power of two."""
    return min(MOST, max(LEAST, 1 << (SHARE * max(1, keys) - 1).bit_length()))


def slots(key: Column, bits: int) -> list[Column]:
    """Two slots of a 64-bit hash."""
    return [F.pmod(F.shiftrightunsigned(key, 32), F.lit(bits)), F.pmod(F.xxhash64(key), F.lit(bits))]


def lanes(hit: DataFrame) -> DataFrame:
    """The filter (lane, words) of the slots in the column `slot`, which may repeat."""
    word = hit.groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("word"))
    lane = word.groupBy(F.floor(F.col("at") / WORDS).alias("lane")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") % WORDS).cast("int"), F.col("word")))).alias("m"))
    return lane.select("lane", F.expr(f"transform(sequence(0, {WORDS - 1}), i -> coalesce(element_at(m, i), 0L))").alias("words"))


def of_keys(keys: DataFrame, bits: int) -> DataFrame:
    """The filter of the hashes in the column `key`."""
    return lanes(keys.select(F.explode(F.array(*slots(F.col("key"), bits))).alias("slot")))


def of_repeats(keys: DataFrame, bits: int) -> DataFrame:
    """The filter of the slots that at least two of the hashes in the column `key` hit."""
    hit = keys.select(F.explode(F.array_distinct(F.array(*slots(F.col("key"), bits)))).alias("slot"))
    return lanes(hit.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1").select("slot"))


def marked(rows: DataFrame, key: str, filt: DataFrame, as_: str, bits: int) -> DataFrame:
    """Adds the boolean column `as_`: false if the filter cannot hold the hash in the column `key`."""
    columns = rows.columns
    filt = F.broadcast(filt)  # at most bits / 8 bytes
    for i, slot in enumerate(slots(F.col(key), bits)):
        mine = filt.select(F.col("lane").alias(f"lane__{i}"), F.col("words").alias(f"words__{i}"))
        rows = rows.withColumn(f"slot__{i}", slot).join(mine, F.floor(F.col(f"slot__{i}") / LANE) == F.col(f"lane__{i}"), "left")
        test = F.expr(f"coalesce(shiftrightunsigned(words__{i}[cast((slot__{i} % {LANE}) div 64 as int)], cast(slot__{i} % 64 as int)) & 1L, 0L) = 1")
        rows = rows.withColumn(f"set__{i}", test).drop(f"words__{i}", f"lane__{i}", f"slot__{i}")
    return rows.select(*columns, (F.col("set__0") & F.col("set__1")).alias(as_))
