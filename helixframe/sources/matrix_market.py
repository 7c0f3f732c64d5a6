"""Matrix Market folders: matrix.mtx with features and barcodes beside it, as Cell Ranger lays them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.ranges import positions


def _lines(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0))


def _head(spark: SparkSession, path: str) -> str:
    """The line of dimensions: the first line of the first part file that has one. Spark reads large files of a folder
    first, so the first row of the whole folder may be an entry."""
    for file in sorted(spark.read.text(path).inputFiles(), key=lambda f: (len(f), f)):
        if found := _lines(spark.read.text(file)).head(1):
            return found[0]["value"]
    raise ValueError(f"{path} has no line of dimensions")


def read_matrix(spark: SparkSession, path: str, cells_as_rows: bool = False) -> tuple[DataFrame, tuple[int, int, int]]:
    """(counts (cell, gene, raw) with indices from 0, (rows, columns, entries)). Lines are split in parallel; only the
    line of dimensions is looked at by the driver. Plain and gzipped files are read alike."""
    lines = _lines(spark.read.text(path))
    head = _head(spark, path)
    dims = tuple(map(int, head.split()))
    part = F.split(F.trim("value"), r"\s+")
    same = lines.filter(F.col("value") == head)
    entries = lines.filter(F.col("value") != head)
    again = same.count() - 1  # an entry may read like the line of dimensions
    if again:
        entries = entries.unionByName(same.limit(again))
    a, b = (part[0].cast("long") - 1), (part[1].cast("long") - 1)
    cell, gene = (a, b) if cells_as_rows else (b, a)
    return entries.select(cell.alias("cell"), gene.alias("gene"), part[2].cast("double").cast("long").alias("raw")), dims


def read_names(spark: SparkSession, path: str, column: str, sep: str = "\t") -> DataFrame:
    """(index from 0, name) of the first column of a file of barcodes or features; its order is that of the file, or of
    part files by name."""
    file = F.col("_metadata.file_path")
    order = {"l__": F.length(file), "f__": file, "b__": F.col("_metadata.file_block_start"), "o__": F.monotonically_increasing_id()}
    rows = spark.read.text(path).select(F.split("value", sep)[0].alias(column), *(v.alias(k) for k, v in order.items()))
    return positions(rows, *order).select((F.col("position") - 1).cast("long").alias("index"), column)


def write_matrix(counts: DataFrame, path: str, genes: int, cells: int) -> None:
    """Writes part files of entries with indices from 1 under `path`, and their header under `path`-header; concatenated
    in that order they are one Matrix Market file."""
    n = counts.count()
    spark = counts.sparkSession
    counts.select(F.concat_ws(" ", (F.col("gene") + 1).cast("string"), (F.col("cell") + 1).cast("string"), F.col("raw").cast("string")).alias("value")).write.mode("overwrite").text(path)
    head = "%%MatrixMarket matrix coordinate integer general\n" + f"{genes} {cells} {n}"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}-header")


def read_table(spark: SparkSession, path: str, key: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """A delimited text file with types inferred and its first column named `key`."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    return df.withColumnRenamed(df.columns[0], key)


def scan_folders(spark: SparkSession, folders: dict[str, str], cells_as_rows: bool = False) -> DataFrame:
    """(exp_id, cells, genes, entries) of Matrix Market folders, as their headers say; only headers are read."""
    found = []
    for k, at in sorted(folders.items()):  # one short read a folder
        a, b, n = map(int, _head(spark, f"{at}/matrix.mtx").split())
        found.append((k, a if cells_as_rows else b, b if cells_as_rows else a, n))
    return spark.createDataFrame(found, "exp_id string, cells long, genes long, entries long")


def read_folders(spark: SparkSession, folders: dict[str, str], how: str = "intersect", cells_as_rows: bool = False) -> DataFrame:
    """(exp_id, cell, gene, raw) of several folders, cells and genes by name, cells preceded by their experiment; genes of
    all of them, or with `union` of any."""
    from functools import reduce

    parts = []
    for k, at in sorted(folders.items()):
        counts, _ = read_matrix(spark, f"{at}/matrix.mtx", cells_as_rows)
        cells = read_names(spark, f"{at}/barcodes.tsv", "barcode").withColumnRenamed("index", "cell")
        genes = read_names(spark, f"{at}/features.tsv", "feature").withColumnRenamed("index", "gene")
        parts.append((k, counts.join(cells, "cell").join(genes, "gene").select(F.lit(k).alias("exp_id"), F.concat_ws("_", F.lit(k), "barcode").alias("cell"), F.col("feature").alias("gene"), "raw"), genes.select("feature", F.lit(k).alias("exp_id"))))
    every = reduce(DataFrame.unionByName, [p for _, p, _ in parts])
    if how == "union":
        return every
    shared = reduce(DataFrame.unionByName, [g for _, _, g in parts]).groupBy(F.col("feature").alias("gene")).agg(F.countDistinct("exp_id").alias("n")).filter(F.col("n") == len(parts))
    return every.join(shared.select("gene"), "gene", "left_semi").select("exp_id", "cell", "gene", "raw")


def write_folder(counts: DataFrame, cells: DataFrame, genes: DataFrame, at: str) -> None:
    """Writes counts (cell, gene, raw) with names of cells (index, name) and genes (index, name) as a folder that
    read_folders() reads: the header goes into the first part file, before entries."""
    spark = counts.sparkSession
    n = counts.count()
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, f"{genes.count()} {cells.count()} {n}")], "part int, line long, value string")
    rows = counts.select(F.lit(1).alias("part"), F.xxhash64("cell", "gene").alias("line"), F.concat_ws(" ", (F.col("gene") + 1).cast("string"), (F.col("cell") + 1).cast("string"), F.col("raw").cast("string")).alias("value"))
    head.unionByName(rows).orderBy("part", "line").select("value").write.mode("overwrite").text(f"{at}/matrix.mtx")
    for table, name in ((cells, "barcodes"), (genes, "features")):
        table.orderBy("index").select(F.col("name").cast("string").alias("value")).write.mode("overwrite").text(f"{at}/{name}.tsv")
