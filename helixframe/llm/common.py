"""Helpers that the document operators share: inputs, row keys, lineage cuts and slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.session import forget, shared_folder, sweep, tables, written  # noqa: F401  for the operators

#: Bytes of text that one numpy step of a Python worker holds at once; a longer text is taken alone.
SLICE_BYTES = 2_000_000


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text) of a table, so that other columns neither travel nor clash; a null text becomes empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds row_key, a hash of doc_id and text. Rows that agree in both are repeats and share it."""
    return docs.withColumn("row_key", F.xxhash64(F.col("doc_id"), F.col("text")))


#: A key with more than this part of all rows is hot; so there are at most as many hot keys.
HOT_PARTS = 10_000
#: Rows of a key that never make it hot.
HOT_LEAST = 100


def hot_keys(sizes: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """Keys of `sizes`, a written table of one row per key with its number of rows in the column `n`, that hold more
    than 1 / HOT_PARTS of all rows; None if there are none. At most HOT_PARTS rows."""
    total = sizes.agg(F.sum(n)).first()[0] or 0
    hot = sizes.filter(F.col(n) > max(HOT_LEAST, total // HOT_PARTS)).select(*keys)
    return hot if hot.head(1) else None


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join of `rows` with at most one row per key in `groups`. The groups of hot keys are broadcast, so their rows
    stay where they are; only the rows of other keys shuffle."""
    if hot is None:
        return rows.join(groups, keys)
    hot = F.broadcast(hot)
    cold = rows.join(hot, keys, "left_anti").join(groups.join(hot, keys, "left_anti"), keys)
    return cold.unionByName(rows.join(F.broadcast(groups.join(hot, keys, "left_semi")), keys))


#: Rows of an Arrow batch of whole texts: a batch is held on both sides of the pipe, and texts are long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of Arrow batches in this session, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches by rows so that each piece holds about `most` bytes of `column` and at most `rows` rows; a row is
    never cut."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (held + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def text_bytes(column: pa.Array):
    """(bytes as uint8, start offsets as int64 with one more at the end) of a string column without nulls."""
    import numpy as np

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
