"""Ranks, adjusted p-values and scalings over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranges import ranged, running


def average_rank(by: list[str], order: Column) -> Column:
    """Rank in ascending order; ties share the mean of their ranks."""
    low = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, order))
    return low + (ties - 1) / 2


def bh_adjusted(p: Column, by: list[str], tests: Column, tie: list[str]) -> Column:
    """Benjamini-Hochberg within `by`, of `tests` tests, absent ones having p = 1. Null p-values stay null."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(p.asc_nulls_last(), *tie))
    scaled = p * tests / rn
    return F.when(p.isNotNull(), F.least(F.lit(1.0), F.min(scaled).over(Window.partitionBy(*by).orderBy(p.desc_nulls_first(), *[F.desc(t) for t in tie]).rowsBetween(Window.unboundedPreceding, 0))))


def weighted_bh(rows: DataFrame, p: str = "pvalue", weight: str = "weight", tie: str = "id") -> DataFrame:
    """Adds spatial_fdr: sum of weights times p over the running weight, made monotone from the largest p down. The order is
    cut into ranges, so no task holds all rows. Null p-values keep a null result."""
    some = ranged(rows.filter(F.col(p).isNotNull()), p, tie)
    total = some.agg(F.sum(weight)).first()[0]
    raw = running(some, [p, tie], F.col(weight), "up__").withColumn("raw__", F.lit(total).cast("double") * F.col(p) / F.col("up__")).drop("up__")
    done = running(raw, [p, tie], F.col("raw__"), "spatial_fdr", least=True, backwards=True).drop("raw__", "range__")
    none = rows.filter(F.col(p).isNull()).withColumn("spatial_fdr", F.lit(None).cast("double"))
    return done.withColumn("spatial_fdr", F.least(F.lit(1.0), "spatial_fdr")).unionByName(none)


def quantile_scaled(x: Column, by: list[Column], cut: float) -> Column:
    """Clipped to the quantiles cut and 1 - cut, then to 0..1; one half where both quantiles agree."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    low, high = F.percentile(x, F.lit(cut)).over(w), F.percentile(x, F.lit(1 - cut)).over(w)
    return F.when(low == high, F.lit(0.5)).otherwise((F.least(F.greatest(x, low), high) - low) / (high - low))
