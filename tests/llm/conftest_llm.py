"""Rows that tests of this folder share."""

import duckdb
from llm_odd import ODD  # noqa: F401


def small(n: int = 200) -> list:
    return duckdb.sql(f"select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id limit {n}").fetchall()
