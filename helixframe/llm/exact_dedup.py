"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one reduces every text to a 64-bit hash and counts, per slot of a bit table, how many rows hit it; slots that two
rows or more hit make the filter. Pass two looks every row up in it. A row whose slots are not all set has no equal
anywhere and passes straight through. Only the others, true repeats and a few false hits, are shuffled, and only as
(id, SHA-256): partial aggregates per digest go first, so a hot text costs one row per task, and what they give for the
largest groups is broadcast, so the rows of a hot text do not move at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import bloom
from helixframe.llm.common import hot_keys, join_groups, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest id stays (nulls before all ids). A null text counts as empty and so equals an empty one.
    Rows repeated with the same id all carry kept = true if that id stays. An empty table gives no rows; columns other
    than the two named are ignored. Texts of any length are hashed whole and never travel. `bits` is the size of the
    filter, by default as many as the number of rows asks for (see bloom.py)."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    bits = bits or bloom.bits_for(docs.count())
    filt = written(bloom.of_repeats(rows.select(F.xxhash64("text").alias("key")), bits))
    probe = rows.select("doc_id", F.xxhash64("text").alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    probe = bloom.marked(probe, "key", filt, "maybe", bits)

    alone = probe.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = probe.filter("maybe").select("doc_id", "text_sha256")
    again = written(again)
    group = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    judged = join_groups(again, group, ["text_sha256"], hot_keys(group, ["text_sha256"], "group_size")).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(judged)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
