"""Vectors packed in binary files: a header, then the numbers row by row; a directory says where each key's vector is."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources import store

#: Mark, byte order (< or >), bytes of a number, numbers of a vector, vectors.
_HEADER = "<4sccIQ"
_MARK = b"PVEC"
#: Vectors that a task reads at once, and that a file holds at most.
RANGE, FILE = 2048, 8192


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def write_packed(vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", *, dims: int, itemsize: int = 4, order: str = "<") -> DataFrame:
    """Writes vectors of `dims` numbers below folder and gives the directory (key, file, row), which is kept beside them.

    Each task writes files of its own, FILE vectors at most each, so nothing is shuffled and no
    file is held whole but these. A vector of another length is an error; null vectors are left out.
    """
    if order not in "<>" or itemsize not in (4, 8):
        raise ValueError("numbers have 4 or 8 bytes, in the order < or >")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _open(folder)
        disk.create_dir(f"{root}/data", recursive=True)
        task, n = TaskContext.get().taskAttemptId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, FILE):
                batch = whole.slice(at, FILE)
                sizes = set(batch.column(1).value_lengths().to_pylist())
                if sizes != {dims}:
                    raise ValueError(f"vectors of {sorted(sizes)} numbers, {dims} expected")
                numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(f"{order}f{itemsize}")
                name = f"part-{task:08d}-{n:04d}.bin"
                with disk.open_output_stream(f"{root}/data/{name}") as out:
                    out.write(struct.pack(_HEADER, _MARK, order.encode(), bytes([itemsize]), dims, batch.num_rows) + numbers.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(np.arange(batch.num_rows))], ["key", "file", "row"])
                n += 1

    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    found = rows.mapInArrow(run, f"key {vectors.schema[key].dataType.simpleString()}, file string, row long")
    return store.write(found, f"{folder}/directory")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/directory")


class _File:
    """One file at a time, whose header and size are checked when it is opened."""

    def __init__(self, folder: str, dims: int, itemsize: int, order: str):
        self.disk, self.root = _open(folder)
        self.want, self.name, self.file = (dims, itemsize, order), None, None

    def rows(self, name: str, first: int, n: int) -> np.ndarray:
        dims, itemsize, order = self.want
        if name != self.name:
            self.name, self.file = name, self.disk.open_input_file(f"{self.root}/data/{name}")
            mark, held, size, numbers, count = struct.unpack(_HEADER, self.file.read(struct.calcsize(_HEADER))) if self.file.size() >= struct.calcsize(_HEADER) else (b"", b"", b"", 0, 0)
            whole = struct.calcsize(_HEADER) + count * numbers * itemsize
            if mark != _MARK or (numbers, size, held) != (dims, bytes([itemsize]), order.encode()) or self.file.size() != whole:
                raise ValueError(f"{name} is damaged or of another kind: {numbers} numbers of {size[:1].hex() or '-'} bytes in order {held!r}, {self.file.size()} bytes, {whole} expected")
        self.file.seek(struct.calcsize(_HEADER) + first * dims * itemsize)
        return np.frombuffer(self.file.read(n * dims * itemsize), f"{order}f{itemsize}").reshape(n, dims)


def _out(keys: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(vectors.astype(f"f{vectors.dtype.itemsize}").ravel())
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), flat)], ["key", "vector"])


def read_packed(spark: SparkSession, folder: str, *, dims: int, itemsize: int = 4, order: str = "<") -> DataFrame:
    """(key, vector) of all, by tasks that read ranges of RANGE vectors. ValueError for a file whose byte order, sizes or length are not as they should be: a damaged index is not read in part."""
    found = directory(spark, folder)
    ranges = found.groupBy("file", F.floor(F.col("row") / RANGE).alias("part")).agg(F.array_sort(F.collect_list(F.struct("row", "key"))).alias("rows"))  # RANGE keys at most
    ranges = ranges.select("file", F.col("rows")[0]["row"].alias("first"), F.col("rows.key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _File(folder, dims, itemsize, order)
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(2)[i].values
                yield _out(keys, held.rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(keys)))

    return ranges.mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, vector array<{'float' if itemsize == 4 else 'double'}>")


def lookup_packed(keys: DataFrame, folder: str, key: str, *, dims: int, itemsize: int = 4, order: str = "<") -> DataFrame:
    """(key, vector) of the asked keys that are known, each read by itself: dims * itemsize bytes a key and no more."""
    found = directory(keys.sparkSession, folder)
    asked = found.join(keys.select(F.col(key).alias("key")).distinct(), "key", "left_semi").repartition("file").sortWithinPartitions("file", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _File(folder, dims, itemsize, order)
        for batch in batches:
            if batch.num_rows:
                yield _out(batch.column(0), np.concatenate([held.rows(f, r, 1) for f, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]))

    return asked.select("key", "file", "row").mapInArrow(run, f"key {found.schema['key'].dataType.simpleString()}, vector array<{'float' if itemsize == 4 else 'double'}>")
