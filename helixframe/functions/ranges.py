"""Running sums, minima and ranks over a whole table: its order is cut into ranges, each a task, and a range starts from what
the ranges before it add up to. Only a row a range reaches the driver."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import written


def ranged(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """The table, written once, with range__: numbers of ranges that follow one another in the order. Rows that agree in it
    share a range, so the order should tell rows apart."""
    cut = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return written(cut.withColumn("range__", F.spark_partition_id()))


def running(rows: DataFrame, order: list[str], value: Column, name: str, least: bool = False, backwards: bool = False) -> DataFrame:
    """Adds `name` to a table of ranged(): the sum, or the least, of a value over all rows up to this one in the order, or from
    this one on if `backwards`. Rows that agree in the order are taken one by one."""
    of, join = (F.min, lambda a, b: b if a is None else a if b is None else min(a, b)) if least else (F.sum, lambda a, b: (a or 0) + (b or 0))
    kind = rows.select(of(value).alias("v")).schema["v"].dataType.simpleString()
    totals = sorted(((r["range__"], r["v"]) for r in rows.groupBy("range__").agg(of(value).alias("v")).collect()), reverse=backwards)
    before = zip((r for r, _ in totals), [None, *accumulate((v for _, v in totals), join)])
    start = rows.sparkSession.createDataFrame(list(before), f"range__ int, start__ {kind}")
    keys = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    inside = of(value).over(Window.partitionBy("range__").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    both = F.least("start__", inside) if least else F.coalesce("start__", F.lit(0)) + inside
    return rows.join(F.broadcast(start), "range__").withColumn(name, F.coalesce(both, "start__")).drop("start__")


def positions(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """Adds position, from 1, in the order."""
    return running(ranged(df, *order, ranges=ranges), list(order), F.lit(1), "position").drop("range__")


def rank_of_all(df: DataFrame, value: str) -> DataFrame:
    """Adds rank: of a column's value among all rows, ties sharing the mean of their ranks. Equal values are counted first,
    so a value that most rows share is one row in the order. Null has no rank."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value__")).agg(F.count("*").alias("n__"))
    up = running(ranged(counted, "value__"), ["value__"], F.col("n__"), "up__")
    at = up.select("value__", (F.col("up__") - (F.col("n__") - 1) / 2).alias("rank"))
    return df.join(at, F.col(value) == F.col("value__"), "left").drop("value__")


def tile(position: Column, n: int, tiles: int) -> Column:
    """The tile, from 1, of a position from 1 among n rows, as ntile() gives it."""
    small, more = divmod(n, tiles)
    at, edge = position - 1, more * (small + 1)
    return F.when(at < edge, F.floor(at / (small + 1)) + 1).otherwise(F.floor((at - edge) / max(small, 1)) + more + 1).cast("int")
