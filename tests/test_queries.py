"""Every query with SQL gives the rows of that SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from helixframe.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def sorted_rows(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = sorted_rows(registry.queries()[name](spark, SMALL).toPandas())
    theirs = sorted_rows(duck.execute(registry.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs) > 0
    for c in ours.columns:
        if ours[c].dtype.kind in "fiu":
            assert (ours[c] - theirs[c].astype(ours[c].dtype)).abs().max() <= 2e-5 or ours[c].isna().all(), c
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c
