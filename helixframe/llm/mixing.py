"""Mixing sources to target weights.

Every document gets a hash-random key. The keys are spread evenly, so the range sort of a source needs no sample: its rows
are dealt to as many ranges of keys as they ask for, a hot source to many. Words are summed up within ranges by a window and
over ranges by another, over one row a range; so each document knows how many words of its source come before it, and is
taken up to the source's exact budget: whole epochs first, then the words before the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import hot_keys, join_groups, written

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST_EPOCHS = 3
#: Rows of a range of keys, about: what one window sorts.
RANGE_ROWS = 4_096
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(doc_id, source, src, size, key): src is the source as a key that is never null, key has 60 bits."""
    text = F.coalesce(docs[text_col], F.lit(""))
    named = F.concat_ws(":", F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.md5(text.cast("binary")))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    source = docs[source_col].cast("string")
    return docs.select(docs[id_col].alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds weight, target and budget (the target rounded down) to a written table of one row per source with its words in
    `source_size`. All words are shared by weight; a source gets at most `most_epochs` times its words, and what is above
    is shared again by weight among the others, until none is above. Sources are taken by code point, null last, and
    weights in turn. One row a source meets in one task."""
    whole = Window.partitionBy()
    pattern = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    ordered = sources.withColumn("number", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("weight", F.get(pattern, F.col("number") % len(weights))).withColumn("most", most_epochs * F.col("source_size"))
    # By falling scarcity: a source is full if an equal share of what the scarcer ones leave would be too much for it.
    before = whole.orderBy(F.col("source_size") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()["words"]
    all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.sum("weight").over(all_rows)
    ordered = ordered.withColumn("left", F.lit(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("among", weight - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ordered = ordered.withColumn("full", F.col("left") * F.col("weight") >= F.col("most") * F.col("among"))
    ordered = ordered.withColumn("left", F.lit(everything) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(all_rows)).withColumn("among", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(all_rows))
    share = F.col("weight") * F.col("left")
    return ordered.select(
        *sources.columns, "weight",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.try_divide(share.cast("double"), F.col("among").cast("double"))).alias("target"),
        F.when(F.col("full"), F.col("most")).otherwise(F.expr("CASE WHEN among > 0 THEN (weight * `left`) DIV among ELSE 0 END")).alias("budget"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, weight, target, budget, start (words of the source
    before it, in its random order) and taken (words that the mix takes, repeats counted).

    taken is size times the whole epochs of the source, and beyond them what of the document lies before the cut; so the
    taken words of a source are its budget exactly, and a document at the cut is taken in part. The order depends on seed,
    id and text only, so reruns agree. A null text has no words and takes none; a source without words has target 0; null
    is a source of its own. Rows that agree in id and text share a key and lie side by side in one range, in any order.
    Texts of any length only add to the counts. An empty table gives no rows; other columns are ignored."""
    rows = written(sized(docs, id_col, text_col, source_col, seed))
    sizes = written(rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    sources = written(targets(sizes, weights, most_epochs).withColumn("ranges", F.ceil(F.col("n") / range_rows).cast("long"))).drop("source", "n")
    rows = join_groups(rows, sources, ["src"], hot_keys(sizes, ["src"]))
    # The key's 60 bits as a fraction of all: the range of its number of ranges that it falls into.
    rows = rows.withColumn("range", F.shiftright(F.shiftright("key", 30) * F.col("ranges"), 30))

    by_range = Window.partitionBy("src", "range")
    inner = by_range.orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = written(rows)
    ranges = rows.groupBy("src", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    over = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(ranges.withColumn("offset", F.coalesce(F.sum("words").over(over), F.lit(0))))
    placed = join_groups(rows, ranges.select("src", "range", "offset"), ["src", "range"], hot_keys(ranges, ["src", "range"]))
    placed = placed.withColumn("start", F.col("within") + F.col("offset"))
    taken = F.expr("CASE WHEN source_size > 0 THEN (budget DIV source_size) * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END")
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target", "budget", "start", taken.alias("taken"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST(CASE number % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS BIGINT) AS weight, {MOST_EPOCHS} * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) AS words
  FROM (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM s)),
f AS (SELECT *, (words - coalesce(sum(most) OVER b, 0)) * weight >= most * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS full_
  FROM w WINDOW b AS (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, CAST(words - coalesce(sum(most) FILTER (full_) OVER (), 0) AS BIGINT) AS left_, CAST(coalesce(sum(weight) FILTER (NOT full_) OVER (), 0) AS BIGINT) AS among FROM f),
t AS (SELECT source, source_size, weight, CASE WHEN full_ THEN CAST(most AS DOUBLE) ELSE CAST(weight * left_ AS DOUBLE) / among END AS target, CASE WHEN full_ THEN most ELSE weight * left_ // among END AS budget FROM r),
p AS (SELECT d.*, source_size, weight, target, budget, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, weight, target, budget, start, CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS taken FROM p
"""
