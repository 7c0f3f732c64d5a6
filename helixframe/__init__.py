"""Analytics for computational biology and text on Spark DataFrames."""
