"""Single-cell HDF5 files as Spark tables: AnnData's h5ad and the matrices of 10x, read in parallel and written.

`spark.read.format("h5sc")` has the options path, layout ("h5ad" or "tenx") and table: the counts ("X", or any other matrix
such as "layers/raw" or "raw/X") as (cell, gene, raw), or "obs" and "var" with an index from 0, a name and their columns.
A partition is a range of rows of the stored matrix or table, and reads only the chunks that hold it; the options entries
and rows set how many it has, about.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.session import forget, written
from helixframe.sources.hdf5 import File, Unsupported, Writer

#: Entries of a matrix that a partition holds, about, and of a batch; rows of a partition of obs or var.
PART_ENTRIES, BATCH_ENTRIES, PART_ROWS = 8_000_000, 500_000, 200_000


class _Matrix:
    """A stored matrix: compressed by cells or by genes, or dense."""

    def __init__(self, file: File, layout: str, table: str) -> None:
        at = _tenx_group(file) if layout == "tenx" else table
        place = file.find(at)
        if place is None:
            raise KeyError(f"no {at} in the file")
        self.dense = file.array(at) if file.is_array(place) else None
        if self.dense is not None:
            if len(self.dense.shape) != 2:
                raise Unsupported("a dense matrix of other than two axes")
            self.shape, self.by_cell, self.rows = self.dense.shape, True, self.dense.shape[0]
            self.entries = self.rows * self.dense.shape[1]
            return
        self.data, self.indices, self.indptr = (file.array(f"{at}/{x}") for x in ("data", "indices", "indptr"))
        self.rows, self.entries = self.indptr.shape[0] - 1, self.data.shape[0]
        if layout == "tenx":
            genes, cells = (int(x) for x in file.array(f"{at}/shape").slice(0, 2))
            self.shape, self.by_cell = (cells, genes), True
            return
        said = file.attributes(place)
        cells, genes = (_length(file, x) for x in ("obs", "var"))
        shape = said.get("shape", said.get("h5sparse_shape"))
        self.shape = tuple(map(int, shape)) if shape is not None else (cells, genes)
        kind = said.get("encoding-type", said.get("h5sparse_format"))
        # Files without a word on it: the pointers are one more than the rows of what the matrix is compressed by.
        self.by_cell = str(kind).startswith("csr") if kind else self.rows == self.shape[0]

    def parts(self, entries: int) -> list[tuple[int, int]]:
        step = max(1, self.rows * entries // max(1, self.entries))
        return [(k, min(self.rows, k + step)) for k in range(0, self.rows, step)]

    def read(self, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(cells, genes, values) of the entries of rows of the stored matrix."""
        if self.dense is not None:
            step = max(1, BATCH_ENTRIES // max(1, self.shape[1]))
            for k in range(start, stop, step):
                block = self.dense.slice(k, min(stop, k + step))
                cell, gene = np.nonzero(block)
                yield cell + k, gene, block[cell, gene]
            return
        ends = self.indptr.slice(start, stop + 1).astype(np.int64)
        for a in range(int(ends[0]), int(ends[-1]), BATCH_ENTRIES):
            z = min(int(ends[-1]), a + BATCH_ENTRIES)
            major = start + np.searchsorted(ends, np.arange(a, z), side="right") - 1
            minor = self.indices.slice(a, z).astype(np.int64)
            yield (*((major, minor) if self.by_cell else (minor, major)), self.data.slice(a, z))


def _tenx_group(file: File) -> str:
    """"matrix", or the genome of files of the older layout."""
    members = file.members(file.root)
    if "matrix" in members:
        return "matrix"
    for name, at in members.items():
        if not file.is_array(at) and "barcodes" in file.members(at):
            return name
    raise KeyError("no matrix of 10x in the file")


def _columns(file: File, layout: str, table: str) -> list[tuple[str, str, str]]:
    """(column, how it is stored, path): the name of rows first."""
    if layout == "tenx":
        at = _tenx_group(file)
        if table == "obs":
            return [("name", "plain", f"{at}/barcodes")]
        found = {"id": "name", "name": "gene_name", "feature_type": "feature_type"} if at == "matrix" else {"genes": "name", "gene_names": "gene_name"}
        base = f"{at}/features" if at == "matrix" else at
        return [(column, "plain", f"{base}/{x}") for x, column in found.items() if file.find(f"{base}/{x}") is not None]
    place = file.find(table)
    if place is None:
        raise KeyError(f"no {table} in the file")
    if file.is_array(place):
        raise Unsupported("a table stored as one array of records")
    members = file.members(place)
    index = file.attributes(place).get("_index", "_index" if "_index" in members else next(iter(members)))
    out = []
    for name, at in members.items():
        if file.is_array(at):
            how = "plain"
        else:
            inside = file.members(at)
            how = "categories" if {"codes", "categories"} <= inside.keys() else "masked" if {"values", "mask"} <= inside.keys() else None
        if how and (how != "plain" or len(file.array(f"{table}/{name}").shape) == 1):
            out.append(("name" if name == index else name, how, f"{table}/{name}"))
    return sorted(out, key=lambda c: c[0] != "name")


def _length(file: File, table: str) -> int:
    _, how, path = _columns(file, "h5ad", table)[0]
    return file.array(path + {"plain": "", "categories": "/codes", "masked": "/values"}[how]).shape[0]


def _column(file: File, how: str, path: str, start: int, stop: int) -> list:
    """Values of a column; missing ones are None."""
    if how == "categories":
        names, codes = file.array(f"{path}/categories"), file.array(f"{path}/codes").slice(start, stop)
        names = [str(x) for x in names.slice(0, names.shape[0])]
        return [names[c] if c >= 0 else None for c in codes.tolist()]
    array = file.array(f"{path}/values" if how == "masked" else path)
    values = array.slice(start, stop)
    if array.kind.spark == "boolean":
        values = values.astype(bool)
    elif array.kind.labels:
        return [array.kind.labels.get(x) for x in values.tolist()]
    values = values.tolist()
    if how == "masked":
        return [None if m else v for v, m in zip(values, file.array(f"{path}/mask").slice(start, stop).tolist(), strict=True)]
    return values


class Rows(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class H5Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.layout, self.table = options["path"], options.get("layout", "h5ad"), options.get("table", "X")
        self.entries, self.rows = int(options.get("entries", PART_ENTRIES)), int(options.get("rows", PART_ROWS))

    def partitions(self) -> list[Rows]:
        with File(self.path) as f:
            if self.table not in ("obs", "var"):
                return [Rows(*x) for x in _Matrix(f, self.layout, self.table).parts(self.entries)] or [Rows(0, 0)]
            _, how, path = _columns(f, self.layout, self.table)[0]
            n = f.array(path + {"plain": "", "categories": "/codes", "masked": "/values"}[how]).shape[0]
        return [Rows(k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with File(self.path) as f:
            if self.table not in ("obs", "var"):
                if partition.stop > partition.start:
                    for cell, gene, value in _Matrix(f, self.layout, self.table).read(partition.start, partition.stop):
                        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(gene, pa.int64()), pa.array(value.astype(np.float64))], names=["cell", "gene", "raw"])
                return
            columns, kinds = _columns(f, self.layout, self.table), dict(x.split(" ") for x in schema_of(f, self.layout, self.table))
            arrays = [pa.array(np.arange(partition.start, partition.stop), pa.int64())]
            arrays += [pa.array(_column(f, how, path, partition.start, partition.stop), _ARROW[kinds[f"`{name}`"]]) for name, how, path in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=["index", *(c[0] for c in columns)])


def schema_of(file: File, layout: str, table: str) -> list[str]:
    if table not in ("obs", "var"):
        return ["cell long", "gene long", "raw double"]
    kind = {"plain": lambda p: file.array(p).kind.spark, "categories": lambda p: "string", "masked": lambda p: file.array(f"{p}/values").kind.spark}
    return ["`index` long", *(f"`{name}` {kind[how](path)}" for name, how, path in _columns(file, layout, table))]


class H5Source(DataSource):
    """The format h5sc."""

    @classmethod
    def name(cls) -> str:
        return "h5sc"

    def schema(self) -> str:
        with File(self.options["path"]) as f:
            return ", ".join(schema_of(f, self.options.get("layout", "h5ad"), self.options.get("table", "X")))

    def reader(self, schema) -> H5Reader:
        return H5Reader(dict(self.options))


def read_h5(spark: SparkSession, path: str, table: str = "X", layout: str = "h5ad", **options) -> DataFrame:
    """A table of a file, see above. Values come as doubles, as files may hold normalised counts."""
    spark.dataSource.register(H5Source)
    return spark.read.format("h5sc").option("path", path).option("table", table).option("layout", layout).options(**options).load()


def read_many(spark: SparkSession, paths: dict[str, str], layout: str = "h5ad", how: str = "intersect") -> DataFrame:
    """(exp_id, cell, gene, raw) of several files, cells and genes by name, cells preceded by their experiment; genes of all
    files, or with `how` "union" of any."""
    if how not in ("intersect", "union"):
        raise ValueError(how)
    out = genes = None
    for k, at in sorted(paths.items()):
        x, obs, var = (read_h5(spark, at, t, layout) for t in ("X", "obs", "var"))
        names = var.select(F.col("index").alias("gene"), F.col("name").alias("gene_name"))
        cells = obs.select(F.col("index").alias("cell"), F.concat(F.lit(f"{k}_"), F.col("name")).alias("cell_name"))
        one = x.join(names, "gene").join(cells, "cell").select(F.lit(k).alias("exp_id"), F.col("cell_name").alias("cell"), F.col("gene_name").alias("gene"), "raw")
        own = names.select(F.col("gene_name").alias("gene")).distinct()
        out, genes = (one, own) if out is None else (out.unionByName(one), genes.join(own, "gene"))
    return out if how == "union" else out.join(genes, "gene", "left_semi").select("exp_id", "cell", "gene", "raw")


def _listed(df: DataFrame, rows: str) -> tuple[str, list[tuple[str, object]]]:
    """(folder of the sorted rows, (column, element type)) of obs or var."""
    kinds = {"string": None, "bigint": np.dtype(np.int64), "int": np.dtype(np.int32), "double": np.dtype(np.float64), "float": np.dtype(np.float32), "boolean": np.dtype(np.bool_)}
    columns = [(c, t) for c, t in df.dtypes if c != "index"]
    for c, t in columns:
        if t not in kinds:
            raise ValueError(f"{rows} has a column {c} of type {t}")
    texts = [c for c, t in columns if t == "string"]
    most = df.agg(F.count("*"), *(F.max(F.octet_length(c)).alias(c) for c in texts)).first().asDict() if texts else {}
    return [(c, max(1, most[c] or 1) if t == "string" else kinds[t]) for c, t in columns]


def write_h5(counts: DataFrame, obs: DataFrame, var: DataFrame, path: str, layout: str = "h5ad", by: str = "cell", chunk: int = 65_536) -> None:
    """Writes counts (cell, gene, raw), with indices from 0, and obs and var (index, name, columns...) into one file that
    must not exist, compressed by cell or, as h5ad allows, by gene. Rows are sorted by Spark; the file itself, being one, is
    written by one task, chunk by chunk, so it holds a chunk and one number a row. A missing text is written as empty, a
    missing number as NaN or 0, a missing truth as false."""
    if layout not in ("h5ad", "tenx") or by not in ("cell", "gene") or (layout == "tenx" and by == "gene"):
        raise ValueError(f"{layout} by {by}")
    minor = "gene" if by == "cell" else "cell"
    x = written(counts.select("cell", "gene", "raw").orderBy(by, minor))
    o, v = written(obs.orderBy("index")), written(var.orderBy("index"))
    kinds = [_listed(o, "obs"), _listed(v, "var")]
    whole = counts.schema["raw"].dataType.simpleString() not in ("double", "float")
    folders = [df.inputFiles()[0].rpartition("/")[0] for df in (x, o, v)]
    sizes = [o.count(), v.count()]

    def rows(folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, at = pafs.FileSystem.from_uri(folder)
        for info in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda i: i.path):  # in the order of the sort
            if info.path.endswith(".parquet"):
                yield from pq.ParquetFile(fs.open_input_file(info.path)).iter_batches(BATCH_ENTRIES, columns=columns)

    def column(folder: str, name: str, dtype) -> Iterator[np.ndarray]:
        for b in rows(folder, [name]):
            c = b.column(0)
            yield np.array([(s or "").encode() for s in c.to_pylist()], f"S{dtype}") if isinstance(dtype, int) else c.fill_null(False).to_numpy(zero_copy_only=False) if dtype == np.bool_ else np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(np.float64)).astype(dtype) if dtype.kind == "i" and c.null_count else c.to_numpy(zero_copy_only=False)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        with fs.open_output_stream(f"{at}.body") as out:
            w = Writer(out, chunk)
            filled = np.zeros(sizes[by == "gene"] + 1, np.int64)
            entries = lambda name: (b.column(0).to_numpy(zero_copy_only=False) for b in rows(folders[0], [name]))
            for major in entries(by):
                filled += np.bincount(major + 1, minlength=len(filled))
            members = {"data": w.array(entries("raw"), np.dtype(np.int32 if whole else np.float64)), "indices": w.array(entries(minor), np.dtype(np.int32)), "indptr": w.array(iter([np.cumsum(filled)]), np.dtype(np.int64))}
            tables = [{c: w.array(column(f, c, t), t) for c, t in k} for f, k in zip(folders[1:], kinds, strict=True)]
            if layout == "h5ad":
                said = {"encoding-type": f"cs{'r' if by == 'cell' else 'c'}_matrix", "encoding-version": "0.1.0", "shape": sizes}
                frame = lambda t, k: w.group({"_index" if c == "name" else c: a for c, a in t.items()}, {"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": "_index"})  # noqa: E731, ARG005
                root = w.group({"X": w.group(members, said), "obs": frame(tables[0], kinds[0]), "var": frame(tables[1], kinds[1])}, {"encoding-type": "anndata", "encoding-version": "0.1.0"})
            else:
                names = {"name": "id", "gene_name": "name"}
                shape = w.array(iter([np.array([sizes[1], sizes[0]])]), np.dtype(np.int64))
                root = w.group({"matrix": w.group({**members, "shape": shape, "barcodes": tables[0]["name"], "features": w.group({names.get(c, c): a for c, a in tables[1].items()})})})
            head = w.head(root)
        # The head knows where the body ends, and stores take no patches: so the file is the head and a copy of the body.
        with fs.open_output_stream(at) as out, fs.open_input_stream(f"{at}.body") as body:
            out.write(head)
            body.read(len(head))
            while piece := body.read(1 << 22):
                out.write(piece)
        fs.delete_file(f"{at}.body")
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    spark = counts.sparkSession
    spark.range(0, 1, 1, 1).mapInArrow(write, "done long").count()
    for df in (x, o, v):
        forget(df)
