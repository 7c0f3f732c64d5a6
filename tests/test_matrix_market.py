"""Matrix Market folders of several part files, of which Spark reads the largest first."""

from helixframe.sources import matrix_market as M


def _parts(folder, *texts):
    folder.mkdir(parents=True)
    for i, t in enumerate(texts):
        (folder / f"part-{i:05d}-x.txt").write_text(t)
    return str(folder)


def test_dimensions_come_from_the_first_part(spark, tmp_path):
    """The first part file is the smallest; one entry reads like the line of dimensions."""
    rest = "".join(f"{g} {c} {g + c}\n" for g in range(1, 9) for c in range(1, 10))
    at = _parts(tmp_path / "m" / "matrix.mtx", "%%MatrixMarket\n9 9 73\n", "", rest + "9 9 73\n")
    counts, dims = M.read_matrix(spark, at)
    assert dims == (9, 9, 73)
    assert sorted(map(tuple, counts.collect())) == sorted([(c - 1, g - 1, g + c) for g in range(1, 9) for c in range(1, 10)] + [(8, 8, 73)])
    assert M.scan_folders(spark, {"m": str(tmp_path / "m")}).collect() == [("m", 9, 9, 73)]


def test_names_follow_the_parts_by_name(spark, tmp_path):
    at = _parts(tmp_path / "barcodes.tsv", "c\tx\n", "b\nlonger name\n", "a\n" + "z\n" * 50)
    got = [r.n for r in M.read_names(spark, at, "n").orderBy("index").collect()]
    assert got == ["c", "b", "longer name", "a"] + ["z"] * 50
