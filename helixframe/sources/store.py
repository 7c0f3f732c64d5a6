"""A folder of Parquet tables: counts in two orders, obs and var. Filters are soft: rows stay, `to_keep` says which count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that cannot be dropped or renamed.
PROTECTED = {"cell", "gene", "to_keep"}


@dataclass(frozen=True)
class CellStore:
    spark: SparkSession
    path: str
    obs_at: str = "obs"
    var_at: str = "var"

    @classmethod
    def create(cls, counts: DataFrame, obs: DataFrame, var: DataFrame, path: str) -> CellStore:
        """Counts are written sorted by cell and by gene, so that filters on either prune row groups."""
        for by in ("cell", "gene"):
            counts.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(f"{path}/counts_by_{by}")
        obs.withColumn("to_keep", F.lit(True)).write.mode("overwrite").parquet(f"{path}/obs")
        var.write.mode("overwrite").parquet(f"{path}/var")
        return cls(counts.sparkSession, path)

    def counts(self, by: str = "cell", kept: bool = True) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/counts_by_{by}")
        return df.join(self.obs(kept=True).select("cell"), "cell", "left_semi") if kept else df

    def obs(self, columns: list[str] | None = None, kept: bool = False) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{self.obs_at}")
        df = df.filter("to_keep") if kept else df
        return df.select(*columns) if columns else df

    def var(self, columns: list[str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{self.var_at}")
        return df.select(*columns) if columns else df

    def updated(self, obs: DataFrame | None = None, var: DataFrame | None = None) -> CellStore:
        """The store with other obs or var. They are written beside the old ones, which readers may still hold."""
        import uuid

        names = {k: f"{k}-{uuid.uuid4().hex}" for k, df in (("obs", obs), ("var", var)) if df is not None}
        for k, df in (("obs", obs), ("var", var)):
            if df is not None:
                df.write.parquet(f"{self.path}/{names[k]}")
        return CellStore(self.spark, self.path, names.get("obs", self.obs_at), names.get("var", self.var_at))

    def add_modality(self, name: str, counts: DataFrame, var: DataFrame) -> None:
        """Counts (cell, gene, raw) of another kind, such as proteins, and their features, under a name of their own; cells
        that the store does not have are left out."""
        counts.join(self.obs().select("cell"), "cell", "left_semi").write.mode("overwrite").parquet(f"{self.path}/{name}_counts")
        var.write.mode("overwrite").parquet(f"{self.path}/{name}_var")

    def modality(self, name: str, kept: bool = True) -> tuple[DataFrame, DataFrame]:
        """(counts, var) of a modality."""
        counts = self.spark.read.parquet(f"{self.path}/{name}_counts")
        counts = counts.join(self.obs(kept=True).select("cell"), "cell", "left_semi") if kept else counts
        return counts, self.spark.read.parquet(f"{self.path}/{name}_var")

    def features(self) -> DataFrame:
        """(feature, kind): columns of obs and all genes."""
        names = self.spark.createDataFrame([(c,) for c in self.obs().columns], "feature string")
        return names.withColumn("kind", F.lit("obs")).unionByName(self.var().select(F.col("gene").cast("string").alias("feature"), F.lit("gene").alias("kind")))


def reordered_var(var: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of var for the genes of a target list (gene, position), in its positions, as the column index."""
    return var.join(genes.select("gene", F.col("position").alias("index")), "gene")


def merged_subsets(obs: DataFrame, subsets: dict[str, DataFrame], columns: list[str], prefix: bool = False, overwrite: bool = False) -> DataFrame:
    """Columns of subsets of cells put back into obs; cells of no subset get null, or keep what they have unless
    `overwrite`. With `prefix` values are preceded by the name of their subset. A cell of several subsets takes the first
    by name."""
    from functools import reduce

    value = lambda k, c: (F.concat_ws("_", F.lit(k), F.col(c).cast("string")) if prefix else F.col(c)).alias(c)
    every = reduce(DataFrame.unionByName, [df.select("cell", F.lit(k).alias("from__"), *(value(k, c) for c in columns)) for k, df in sorted(subsets.items())])
    one = every.groupBy("cell").agg(F.min_by(F.struct(*columns), "from__").alias("new__"))
    j = obs.join(one, "cell", "left")
    old = lambda c: F.col(c) if c in obs.columns and not overwrite else F.lit(None)
    return j.withColumns({c: F.coalesce(F.col(f"new__.{c}"), old(c)) for c in columns}).drop("new__")


def with_columns(obs: DataFrame, new: DataFrame, key: str = "cell") -> DataFrame:
    """Adds the columns of `new` by key, replacing those of the same name; rows without a match get null."""
    fresh = [c for c in new.columns if c != key]
    return obs.drop(*fresh).join(new, key, "left")


def keep_cells(obs: DataFrame, cells: DataFrame | None) -> DataFrame:
    """Sets to_keep to whether a cell is in `cells`; None keeps all again."""
    if cells is None:
        return obs.withColumn("to_keep", F.lit(True))
    mark = cells.select("cell").distinct().withColumn("k__", F.lit(True))
    return obs.drop("to_keep").join(mark, "cell", "left").withColumn("to_keep", F.col("k__").isNotNull()).drop("k__")


def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    if bad := PROTECTED & names.keys():
        raise ValueError(f"protected columns: {sorted(bad)}")
    return table.withColumnsRenamed(names)


def dropped(table: DataFrame, names: list[str]) -> DataFrame:
    if bad := PROTECTED & set(names):
        raise ValueError(f"protected columns: {sorted(bad)}")
    return table.drop(*names)


def snake_case(table: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    import re

    return table.withColumnsRenamed({c: re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c).lower()).strip("_") for c in table.columns})
