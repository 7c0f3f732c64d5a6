"""A pipeline over the table of documents: each stage takes what its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontaminate, langid, line_dedup, queries, simhash
from helixframe.llm.common import sweep, tables, written
from helixframe.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the learned languages: those whose best score is below langid.FLOOR, those without
    letters, and those without a text."""
    model = langid.fit(langid.training_sample(docs, ~queries.held_out()))
    told = langid.identify(docs, model, carry=("text", "lang", "source", "n_chars"))
    return told.filter((F.col("lang_pred") != langid.NONE) & (F.col("score") >= langid.FLOOR)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; a document of which nothing but blanks is left goes."""
    left = line_dedup.drop_lines(docs, carry=("lang", "source")).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds row_key, a hash of all columns: stages judge rows, and ids may be null or repeated."""
    return docs.withColumn("row_key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))


def _same_row():
    return (F.col("row_key") == F.col("key__")) & F.col("doc_id").eqNullSafe(F.col("id__"))


def _ids(judged: DataFrame) -> DataFrame:
    return judged.select(F.col("doc_id").alias("id__"), F.col("row_key").alias("key__")).distinct()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, of several the one with the smallest hash of all
    columns; rows without an id come last. Rows that agree in all columns are copies as well."""
    docs = _keyed(docs)
    stay = _ids(simhash.near_duplicates(docs, key="row_key").filter("stays"))
    return docs.join(stay, _same_row(), "left_semi").dropDuplicates(["doc_id", "row_key"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in windows of benchmark items go."""
    docs = _keyed(docs)
    found = decontaminate.find_contamination(docs, queries.table(spark, sf_dir, "benchmark"), key="row_key")
    return docs.join(_ids(found.filter(queries.contaminated())), _same_row(), "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is kept, encoded, with the text that the ids decode to: doc_id, n_tokens, ids, decoded."""
    coded = bpe.encode_decode(docs, queries.tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the kernel classifier nor the encoding; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written to the shared folder and read again, and what the
    stage has left there besides is deleted."""
    ship(spark)
    docs, before = queries.table(spark, sf_dir, "documents"), tables()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            sweep(spark, before, docs)
    return docs
