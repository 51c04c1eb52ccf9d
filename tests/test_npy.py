from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvestat.sources import npy


def rows(spark, cube):
    lead = np.ndindex(*cube.shape[:-1])
    columns = ", ".join(f"a{i} int" for i in range(cube.ndim - 1)) + ", y array<double>"
    return spark.createDataFrame([(*at, cube[at].tolist()) for at in lead], columns)


def axes(cube):
    return {f"a{i}": n for i, n in enumerate(cube.shape[:-1])}


def test_a_cube_of_four_axes_comes_back_and_numpy_reads_it(spark, tmp_path):
    cube = np.random.default_rng(3).normal(size=(3, 2, 5, 7))
    cube[1, 1, 2, 3], cube[0, 0, 0, 0] = np.nan, np.inf
    path = str(tmp_path / "cube.npy")
    npy.write_cube(rows(spark, cube).orderBy(F.rand(1)), path, axes(cube), 7)
    np.testing.assert_array_equal(np.load(path), cube)
    assert [p.name for p in tmp_path.iterdir()] == ["cube.npy"]
    back = npy.read_cube(spark, "file://" + path, ["participant", "action", "trial"], slice_bytes=4 * 7 * 8)
    assert back.rdd.getNumPartitions() == 8
    got = {(r["participant"], r["action"], r["trial"]): r["y"] for r in back.collect()}
    assert len(got) == 30
    for at in np.ndindex(3, 2, 5):
        np.testing.assert_array_equal(got[at], cube[at])


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "|u1"])
def test_types_are_read_as_doubles(spark, tmp_path, dtype):
    cube = np.arange(24).reshape(4, 6).astype(dtype)
    np.save(tmp_path / "c.npy", cube)
    got = npy.read_cube(spark, str(tmp_path / "c.npy")).orderBy("a0").collect()
    assert [r["y"] for r in got] == cube.astype(float).tolist()


def test_a_slice_reads_its_own_bytes(tmp_path, monkeypatch):
    np.save(tmp_path / "c.npy", np.arange(1000.0 * 8).reshape(1000, 8))
    reader = npy.CubeReader(str(tmp_path / "c.npy"), 100 * 64)
    opened, seen = npy._opened, []

    class Watched:
        def __init__(self, f):
            self.f, self.at = f, 0

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.at = at
            self.f.seek(at)

        def read(self, n):
            seen.append((self.at, n))
            return self.f.read(n)

    monkeypatch.setattr(npy, "_opened", lambda path: Watched(opened(path)))
    monkeypatch.setattr(npy, "PIECE", 40 * 64)
    parts = reader.partitions()
    assert len(parts) == 10
    got = list(reader.read(parts[3]))
    start = reader.header.start
    assert seen == [(start + 300 * 64, 40 * 64), (start + 340 * 64, 40 * 64), (start + 380 * 64, 20 * 64)]
    assert sum(b.num_rows for b in got) == 100 and got[0].column(0)[0].as_py() == 300


def test_empty_and_refused_cubes(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3, 5)))
    assert npy.read_cube(spark, str(tmp_path / "none.npy")).count() == 0
    np.save(tmp_path / "fortran.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "line.npy", np.ones(3))
    np.save(tmp_path / "objects.npy", np.array([[None, 1]], dtype=object))
    np.save(tmp_path / "short.npy", np.ones((50, 4)))
    (tmp_path / "short.npy").write_bytes((tmp_path / "short.npy").read_bytes()[:-1])
    (tmp_path / "text.npy").write_text("no")
    for name in ("fortran", "line", "objects", "short", "text"):
        with pytest.raises(ValueError):
            npy.header(str(tmp_path / f"{name}.npy"))


@pytest.mark.parametrize("problem", ["missing", "twice", "twice and missing", "outside", "length", "null value", "null curve"])
def test_what_a_writer_refuses(spark, tmp_path, problem):
    cube = np.arange(24.0).reshape(2, 3, 4)
    df = rows(spark, cube)
    one = (F.col("a0") == 1) & (F.col("a1") == 2)
    put = {
        "missing": df.filter(~one), "twice": df.unionByName(df.filter(one)), "twice and missing": df.filter("NOT (a0 = 0 AND a1 = 0)").unionByName(df.filter(one)),
        "outside": df.withColumn("a1", F.when(one, 3).otherwise(F.col("a1"))), "length": df.withColumn("y", F.when(one, F.slice("y", 1, 3)).otherwise(F.col("y"))),
        "null value": df.withColumn("y", F.when(one, F.transform("y", lambda v: F.nullif(v, F.lit(23.0)))).otherwise(F.col("y"))),
        "null curve": df.withColumn("y", F.when(~one, F.col("y"))),
    }[problem]
    path = tmp_path / "c.npy"
    path.write_text("before")
    with pytest.raises(Exception):
        npy.write_cube(put, str(path), axes(cube), 4)
    assert path.read_text() == "before" and [p.name for p in tmp_path.iterdir()] == ["c.npy"]


def test_an_existing_target_and_positions(spark, tmp_path):
    cube = np.ones((2, 2, 1))
    path = str(tmp_path / "c.npy")
    npy.write_cube(rows(spark, cube), path, axes(cube), 1, overwrite=False)
    with pytest.raises(Exception, match="exists"):
        npy.write_cube(rows(spark, cube), path, axes(cube), 1, overwrite=False)
    labelled = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    placed, n = npy.positions(labelled, "name", "at")
    assert n == 2 and sorted(tuple(r) for r in placed.collect()) == [("a", 0), ("b", 1), ("b", 1)]
