"""The driver's tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell = customer, gene = part, raw = pieces bought."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return j.groupBy(F.col("o_custkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("long").alias("raw"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("batch"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and by type."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("member")).unionByName(p.select(F.col("p_type").alias("set_id"), F.col("p_partkey").alias("member")))


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample = customer, feature = brand, value = pieces bought; zeros left out."""
    c = counts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("feature")), "gene")
    return c.groupBy(F.col("cell").alias("sample"), "feature").agg(F.sum("raw").cast("double").alias("value"))


COUNTS = "counts AS (SELECT o_custkey AS cell, l_partkey AS gene, CAST(sum(l_quantity) AS BIGINT) AS raw FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
OBS = "obs AS (SELECT c_custkey AS cell, c_mktsegment AS segment, c_nationkey AS batch FROM customer)"
SETS = "sets AS (SELECT p_brand AS set_id, p_partkey AS member FROM part UNION SELECT p_type, p_partkey FROM part)"
NORM = COUNTS + ", lib AS (SELECT cell, sum(raw) AS lib_size FROM counts GROUP BY 1), norm AS (SELECT cell, gene, raw, ln(1 + raw / lib_size * 10000.0) AS norm FROM counts JOIN lib USING (cell))"
EXPR = COUNTS + ", expr AS (SELECT cell AS sample, p_brand AS feature, CAST(sum(raw) AS DOUBLE) AS value FROM counts JOIN part ON gene = p_partkey GROUP BY 1, 2)"
DENSE = EXPR + ", dense AS (SELECT s.sample, f.feature, coalesce(e.value, 0.0) AS value FROM (SELECT DISTINCT sample FROM expr) s CROSS JOIN (SELECT DISTINCT feature FROM expr) f LEFT JOIN expr e ON e.sample = s.sample AND e.feature = f.feature)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
