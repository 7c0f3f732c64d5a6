import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_odd import ODD  # noqa: E402
@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, a long word and extra columns whose names operators use inside."""
    rows = [(i, t, "en" if k % 2 else None, "s", k, k) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_key int, runs int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
