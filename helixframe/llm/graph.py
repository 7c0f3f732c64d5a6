"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import forget, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); component is the smallest node that is reached.

    Null ends and loops are ignored, repeated links count once, no links give no rows. Each round links every node
    straight to the smallest neighbour it knows, so the number of rounds grows with the logarithm of the longest chain.
    Rounds end in tables of the shared folder."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    edges = written(edges.filter("u <> v").select(u.alias("u"), v.alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        # Large star: each node's larger neighbours go to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")).select("at", F.least("at", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        small = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        joined = large.join(small, F.col("u") == F.col("at"))
        new = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old, edges = edges, written(new)
        forget(old)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
