"""Queries without SQL take whole tables."""

from helixframe.plans import registry
from test_queries import SMALL


def test_imputation_of_all_dimensions(spark):
    size = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("count(*) as n", "max(size(embedding)) as d").first()
    got = registry.queries()["magic_imputation"](spark, SMALL).select("cell", "gene").distinct()
    assert size["d"] > 4 and got.count() == size["n"] * size["d"]
