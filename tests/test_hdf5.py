"""HDF5: what is written comes back, and files laid out in the other ways that the format knows."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.session import shared_folder
from helixframe.sources import h5ad
from helixframe.sources.hdf5 import NOWHERE, File, Unsupported, Writer, _kind_message


def test_arrays_come_back(tmp_path):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=100_003), rng.integers(-5, 1000, 7_000).astype(np.int32)  # more chunks than a node has children
    names = [f"cell_é{i}" for i in range(300)]
    at = str(tmp_path / "a.h5")
    with open(at, "w+b") as f:
        w = Writer(f, chunk=100)
        a = w.array(iter(np.array_split(x, 7)), np.dtype(np.float64), {"encoding-type": "array"})
        b, c = w.array(iter([y]), np.dtype(np.int32)), w.array(iter([np.array([s.encode() for s in names])]), 12)
        d, e = w.array(iter([y > 3]), np.dtype(np.bool_)), w.array(iter([]), np.dtype(np.int64))
        inner = w.group({"x": a, "y": b}, {"shape": [3, 4], "word": "csr_matrix"})
        root = w.group({"X": inner, "names": c, "flag": d, "none": e, **{f"m{i:04}": b for i in range(300)}})
        f.seek(0)
        f.write(w.head(root))
    with File(at) as f:
        assert len(f.members(f.root)) == 304 and f.find("X/z") is None
        said = f.attributes(f.find("X"))
        assert said["word"] == "csr_matrix" and list(said["shape"]) == [3, 4]
        assert (f.array("X/x").slice(0, 10**9) == x).all() and (f.array("X/x").slice(1234, 77_777) == x[1234:77_777]).all()
        assert (f.array("X/y").slice(0, 7_000) == y).all() and list(f.array("names").slice(5, 9)) == names[5:9]
        assert (f.array("flag").slice(0, 7_000) == (y > 3)).all() and len(f.array("none").slice(0, 4)) == 0
        with pytest.raises(KeyError):
            f.array("X")
    (tmp_path / "b.h5").write_bytes(b"no such file" * 20)
    with pytest.raises(Unsupported):
        File(str(tmp_path / "b.h5"))


class Newer:
    """A file of the newer kind: superblock 2, headers with signatures, links as messages, contiguous arrays, variable strings."""

    def __init__(self):
        self.b = bytearray(64)

    def put(self, raw):
        at = len(self.b)
        self.b += raw + bytes(-len(raw) % 8)
        return at

    def header(self, messages):
        body = b"".join(struct.pack("<BHB", n, len(m), 0) + m for n, m in messages)
        return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))

    def array(self, x, kind=None, raw=None):
        x = np.asarray(x) if raw is None else x
        shape = x.shape if raw is None else (len(x),)
        raw = x.tobytes() if raw is None else raw
        at = self.put(raw)
        space = struct.pack(f"<4B{len(shape)}Q", 2, len(shape), 0, 1, *shape)
        return self.header([(1, space), (3, kind or _kind_message(x.dtype)), (8, struct.pack("<BBQQ", 3, 1, at, len(raw)))])

    def strings(self, names):
        heap, refs = b"", b""
        for i, s in enumerate(names, 1):
            b = s.encode()
            heap += struct.pack("<HHIQ", i, 1, 0, len(b)) + b + bytes(-len(b) % 8)
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(heap) + 16) + heap + bytes(16))
        for i, s in enumerate(names, 1):
            refs += struct.pack("<IQI", len(s.encode()), at, i)
        kind = struct.pack("<B3BI", 0x19, 1, 1, 0, 16) + struct.pack("<B3BIHH", 0x10, 0, 0, 0, 1, 0, 8)
        return self.array(names, kind, refs)

    def group(self, members, **said):
        links = [(6, struct.pack("<BBB", 1, 0, len(k)) + k.encode() + struct.pack("<Q", a)) for k, a in members.items()]
        for k, v in said.items():
            raw, name = v.encode(), k.replace("__", "-").encode() + b"\0"
            kind, space = _kind_message(len(raw)), struct.pack("<4B", 2, 0, 0, 0)
            links.append((12, struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 0) + name + kind + space + raw))
        return self.header([(2, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), *links])

    def save(self, at, root):
        self.b[:48] = b"\x89HDF\r\n\x1a\n" + struct.pack("<4BQQQQI", 2, 8, 8, 0, 0, NOWHERE, len(self.b), root, 0)
        at.write_bytes(bytes(self.b))
        return str(at)


def newer(tmp_path, x, dense):
    f = Newer()
    if dense:
        matrix = f.array(x)
    else:  # by gene, without a word on it
        gene, cell = np.nonzero(x.T)
        matrix = f.group({"data": f.array(x.T[gene, cell]), "indices": f.array(cell.astype(np.int32)), "indptr": f.array(np.concatenate([[0], np.cumsum((x != 0).sum(0))]).astype(np.int64))})
    codes = f.group({"codes": f.array(np.array([0, -1, 1, 0], np.int8)), "categories": f.strings(["T cell", "B cell"])})
    masked = f.group({"values": f.array(np.array([5, 6, 7, 8])), "mask": f.array(np.array([0, 1, 0, 0], np.int8))})
    obs = f.group({"ids": f.strings(["c0", "cé", "c2", "c3"]), "kind": codes, "age": masked, "score": f.array(np.arange(4) / 2)}, _index="ids")
    var = f.group({"_index": f.strings(["g0", "g1", "g2"])})
    return f.save(tmp_path / f"{dense}.h5ad", f.group({"X": matrix, "obs": obs, "var": var}))


@pytest.mark.parametrize("dense", [True, False])
def test_newer_files(spark, tmp_path, dense):
    x = np.array([[1.5, 0, 2], [0, 0, 0], [0, 3, 0], [4, 5, 6]])
    at = newer(tmp_path, x, dense)
    got = {(r["cell"], r["gene"]): r["raw"] for r in h5ad.read_h5(spark, at).collect()}
    assert got == {(int(i), int(j)): x[i, j] for i, j in zip(*np.nonzero(x), strict=True)}
    obs = sorted(map(tuple, h5ad.read_h5(spark, at, "obs").select("index", "name", "kind", "age", "score").collect()))
    assert obs == [(0, "c0", "T cell", 5, 0.0), (1, "cé", None, None, 0.5), (2, "c2", "B cell", 7, 1.0), (3, "c3", "T cell", 8, 1.5)]
    assert h5ad.read_h5(spark, at, "var").schema.names == ["index", "name"]
    with pytest.raises(Exception, match="layers"):
        h5ad.read_h5(spark, at, "layers/raw").count()


def test_files_of_many_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), int(g), int(rng.integers(1, 9))) for c in range(40) for g in rng.choice(30, 0 if c % 7 == 3 else 6, replace=False)]
    counts = spark.createDataFrame(rows, "cell long, gene long, raw long").repartition(5)
    obs = spark.range(40).select(F.col("id").alias("index"), F.concat(F.lit("b"), "id").alias("name"), F.when(F.col("id") > 5, F.lit("x")).alias("label"))
    var = spark.range(30).select(F.col("id").alias("index"), F.concat(F.lit("g"), "id").alias("name"), F.lit("Gene Expression").alias("feature_type"))
    for k, (layout, by) in enumerate((("h5ad", "cell"), ("h5ad", "gene"), ("tenx", "cell"))):
        at = f"{shared_folder(spark)}/many-{k}-{id(counts)}.h5"
        h5ad.write_h5(counts, obs, var, at, layout, by, chunk=16)
        x = h5ad.read_h5(spark, at, "X", layout, entries=17)
        assert x.rdd.getNumPartitions() > 3 and sorted(map(tuple, x.collect())) == sorted((c, g, float(v)) for c, g, v in rows)
        o = h5ad.read_h5(spark, at, "obs", layout, rows=9)
        assert o.rdd.getNumPartitions() == 5 and sorted((r["index"], r["name"]) for r in o.collect()) == [(i, f"b{i}") for i in range(40)]
        v = h5ad.read_h5(spark, at, "var", layout)
        assert {r["feature_type"] for r in v.collect()} == {"Gene Expression"} and v.count() == 30
    both = h5ad.read_many(spark, {"p": f"{shared_folder(spark)}/many-2-{id(counts)}.h5"}, "tenx")
    assert both.count() == len(rows) and both.filter("cell not like 'p_b%'").count() == 0
    at = f"{shared_folder(spark)}/none-{id(counts)}.h5"
    h5ad.write_h5(counts.limit(0), obs, var, at)
    assert h5ad.read_h5(spark, at).count() == 0 and h5ad.read_h5(spark, at, "obs").count() == 40
    with pytest.raises(ValueError):
        h5ad.write_h5(counts, obs, var, at, "tenx", "gene")
