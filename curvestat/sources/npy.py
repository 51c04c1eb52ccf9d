"""Cubes of curves in NumPy's .npy files, read and written in slices by a Python data source.

A cube has two axes or more in C order; the last one is the curve, the others number the curves. A curve's *place* is its
position among all, with the first axis slowest.

Reading (``read_cube``): the header gives shape and type, and partitions are byte ranges of whole curves, of about
``SLICE`` bytes. A task reads its range in pieces of ``PIECE`` bytes and nothing else, so the size of a file doesn't matter.
Any file system that Arrow opens will do.

Writing (``write_cube``): curves are dealt by slices of places and sorted in their task, which writes each run of neighbours at
its offset of one file beside the target. A task that runs again writes the same bytes. The commit counts the curves, writes
the header and renames the file, so the target is the old one or whole. The folder must be one that the cluster shares
and that can be written at offsets (a mounted one; object stores can't).

Refused with a ValueError or a failed job: types other than plain floats and integers, Fortran order, a single axis, a file shorter
than its header says, curves missing, given twice, outside the shape, null, of other lengths or with null values, and an existing
target unless it may be replaced. NaN and infinities are values. A cube without curves (an axis of length 0) reads as no rows.
"""

from __future__ import annotations

import io
import math
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from curvestat.operators.lineage import cut, few

SLICE = 64 << 20
PIECE = 4 << 20


def _opened(path: str):
    """An input file with random access."""
    local = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


@dataclass(frozen=True)
class Header:
    shape: tuple[int, ...]
    dtype: str
    start: int

    @property
    def row_bytes(self) -> int:
        return self.shape[-1] * np.dtype(self.dtype).itemsize

    @property
    def curves(self) -> int:
        return math.prod(self.shape[:-1])


def header(path: str) -> Header:
    """Shape, type and offset of the first value."""
    with _opened(path) as f:
        lead = f.read(12)
        if len(lead) < 12:
            raise ValueError(f"{path} is no .npy file")
        stream = io.BytesIO(lead)
        version = np.lib.format.read_magic(stream)
        if version not in ((1, 0), (2, 0)):
            raise ValueError(f"{path} has version {version}")
        width = 2 if version == (1, 0) else 4
        f.seek(0)
        stream = io.BytesIO(f.read(8 + width + int.from_bytes(lead[8 : 8 + width], "little")))
        np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if width == 2 else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(stream)
        found = Header(shape, dtype.str, stream.tell())
        if dtype.kind not in "fiu" or fortran or len(shape) < 2:
            raise ValueError(f"{path} is no cube of numbers in C order: {dtype}, {shape}")
        if f.size() < found.start + found.curves * found.row_bytes:
            raise ValueError(f"{path} ends before its {found.curves} curves do")
        return found


@dataclass
class Slice(InputPartition):
    first: int
    curves: int


class CubeReader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int) -> None:
        self.path, self.header, self.slice_bytes = path, header(path), slice_bytes

    def partitions(self) -> list[Slice]:
        step = max(1, self.slice_bytes // max(1, self.header.row_bytes))
        total = self.header.curves
        return [Slice(at, min(step, total - at)) for at in range(0, total, step)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        h = self.header
        length, step = h.shape[-1], max(1, PIECE // max(1, h.row_bytes))
        with _opened(self.path) as f:
            for at in range(partition.first, partition.first + partition.curves, step):
                n = min(step, partition.first + partition.curves - at)
                f.seek(h.start + at * h.row_bytes)
                raw = f.read(n * h.row_bytes)
                if len(raw) < n * h.row_bytes:
                    raise ValueError(f"{self.path} was cut short")
                values = np.frombuffer(raw, dtype=h.dtype).astype("float64")
                axes = np.unravel_index(np.arange(at, at + n), h.shape[:-1])
                curves = pa.ListArray.from_arrays(np.arange(0, (n + 1) * length, length, dtype="int32") if length else np.zeros(n + 1, "int32"), values)
                yield pa.RecordBatch.from_arrays([*[pa.array(a.astype("int64")) for a in axes], curves], names=[*[f"a{i}" for i in range(len(axes))], "y"])


@dataclass
class Written(WriterCommitMessage):
    curves: int


class CubeWriter(DataSourceArrowWriter):
    """Rows (place, y), each slice of places whole in one task and in order."""

    def __init__(self, path: str, shape: tuple[int, ...], overwrite: bool) -> None:
        self.path = re.sub(r"^file:/+", "/", path)
        if not self.path.startswith("/"):
            raise ValueError(f"{path} can't be written at offsets; name a mounted folder that the cluster shares")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{path} exists")
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.shape, self.total = shape, math.prod(shape[:-1])
        lead = io.BytesIO()
        np.lib.format.write_array_header_1_0(lead, {"descr": "<f8", "fortran_order": False, "shape": shape})
        self.lead = lead.getvalue()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        length, count, last = self.shape[-1], 0, -1
        with open(os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o644), "wb") as f:
            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                places, curves = batch.column(0), batch.column(1)
                if places.null_count or curves.null_count or pc.any(pc.not_equal(pc.list_value_length(curves), length)).as_py():
                    raise ValueError(f"a curve without place or of another length than {length}")
                at, values = places.to_numpy(zero_copy_only=False), pc.list_flatten(curves)
                if values.null_count:
                    raise ValueError("a curve holds nulls")
                if at.min() < 0 or at.max() >= self.total:
                    raise ValueError(f"a curve lies outside the shape {self.shape}")
                rises = np.diff(at, prepend=last)
                if (rises == 0).any():
                    raise ValueError(f"place {at[rises == 0][0]} occurs twice")
                data = np.ascontiguousarray(values.to_numpy(zero_copy_only=False), "<f8").reshape(len(at), length)
                for run in np.split(np.arange(len(at)), np.flatnonzero(rises[1:] != 1) + 1):
                    f.seek(len(self.lead) + int(at[run[0]]) * length * 8)
                    f.write(data[run[0] : run[-1] + 1].tobytes())
                count, last = count + len(at), at[-1]
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.curves for m in messages if m is not None)
        if found != self.total:
            self.abort(messages)
            raise ValueError(f"{found} curves for the {self.total} places of {self.shape}")
        with open(os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o644), "wb") as f:
            f.write(self.lead)
            f.truncate(len(self.lead) + self.total * self.shape[-1] * 8)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class NpyCube(DataSource):
    """format("npy_cube"): options path, slice_bytes (reading), shape (writing, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "npy_cube"

    def schema(self) -> T.StructType:
        axes = len(header(self.options["path"]).shape) - 1
        return T.StructType([*[T.StructField(f"a{i}", T.LongType(), False) for i in range(axes)], T.StructField("y", T.ArrayType(T.DoubleType()), False)])

    def reader(self, schema: T.StructType) -> CubeReader:
        return CubeReader(self.options["path"], int(self.options.get("slice_bytes", SLICE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> CubeWriter:
        return CubeWriter(self.options["path"], tuple(int(n) for n in self.options["shape"].split(",")), overwrite)


def read_cube(spark: SparkSession, path: str, axes: list[str] | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """A row for each curve: its position (from 0) on each leading axis, and y."""
    spark.dataSource.register(NpyCube)
    cube = spark.read.format("npy_cube").option("slice_bytes", slice_bytes).load(path)
    if axes is None:
        return cube
    if len(axes) != len(cube.columns) - 1:
        raise ValueError(f"{path} has {len(cube.columns) - 1} axes before the curve")
    return cube.toDF(*axes, "y")


def write_cube(df: DataFrame, path: str, axes: dict[str, int], length: int, value: str = "y", overwrite: bool = True) -> None:
    """One cube from rows that hold a position (from 0) in each axis column; axes: column and size, slowest first."""
    df.sparkSession.dataSource.register(NpyCube)
    place, inside = F.lit(0).cast("long"), F.lit(True)
    for column, size in axes.items():
        place, inside = place * size + F.col(column), inside & F.col(column).between(0, size - 1)
    step = max(1, SLICE // max(1, 8 * length))
    rows = df.select(F.when(inside, place).alias("place"), F.col(value).cast("array<double>").alias("y"))
    dealt = rows.repartition(F.floor(F.col("place") / step)).sortWithinPartitions("place")
    shape = ",".join(map(str, [*axes.values(), length]))
    dealt.write.format("npy_cube").option("shape", shape).mode("overwrite" if overwrite else "append").save(path)


def positions(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """df with each label's place (from 0) among the sorted labels of a column, and their number; null is no label and its rows go."""
    listed = cut(df.agg(F.sort_array(F.collect_set(column)).alias("x")).select(F.posexplode("x").alias(name, "label_")))
    return df.join(few(listed), df[column] == listed["label_"]).drop("label_"), listed.count()
