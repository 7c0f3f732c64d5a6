"""Chains of steps over experiments, for all cells at once or for each group of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A step takes and returns a frame; `needs` are the columns that it reads.
Step = tuple[str, Callable[[DataFrame], DataFrame], tuple[str, ...]]


def missing_columns(steps: list[Step], columns: list[str]) -> list[tuple[str, str]]:
    """(step, column) that the first step lacks; later steps see what the ones before return."""
    return [(steps[0][0], c) for c in steps[0][2] if c not in columns] if steps else []


def applied(table: DataFrame, steps: list[Step]) -> DataFrame:
    """The steps in order; columns that a step needs must be there when its turn comes."""
    for name, f, needs in steps:
        if lack := [c for c in needs if c not in table.columns]:
            raise ValueError(f"{name} lacks {lack}")
        table = table.transform(f)
    return table


def applied_per_group(table: DataFrame, obs: DataFrame, group: str, steps: list[Step]) -> DataFrame:
    """The steps for the cells of each group (cell, group) by themselves, results with the group in front. One plan a group,
    so groups are few."""
    names = [r[0] for r in obs.select(group).dropna().distinct().orderBy(group).collect()]
    parts = [applied(table.join(obs.filter(F.col(group) == n).select("cell"), "cell", "left_semi"), steps).select(F.lit(n).alias(group), "*") for n in names]
    return reduce(DataFrame.unionByName, parts) if parts else applied(table.limit(0), steps).select(F.lit(None).cast(obs.schema[group].dataType).alias(group), "*")
