"""What the operators share: the shared folder, staged tables, tiles of large
groups, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a tile's side: no task compares more than twice as many rows at once.
TILE = 512
#: Separators of words: the bytes that Python's bytes.split() and [\x20\x09-\x0D] name alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may go without one: it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="cartulary-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs a read and not the work before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a staged table that no later step reads."""
        self.remove(df._staged_at)

    def remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


_RESIDENT: dict = {}


def trim() -> None:
    """Gives memory that is free in this process back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which trims when it is done: between tasks a worker keeps what is resident, and no more."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def resident(owner: str, key, make: Callable):
    """What an operator keeps in a worker between tasks (vocabularies, indexes, model slices). Only one operator's is kept: the worker outlives the operator."""
    if _RESIDENT.get("owner") != owner:
        _RESIDENT.clear()
        trim()
        _RESIDENT["owner"] = owner
    if key not in _RESIDENT:
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased. bytes.lower() and bytes.split() know ASCII only, as the definition does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id falls in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text whose separators are spaces, in parts of about size bytes cut at spaces, so that the words of a very long text are never all in memory."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def stretches(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from lo on, size of them, of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each begins (with the end)."""
    column = column.cast(pa.large_string())
    offsets, data = column.buffers()[1:]
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The column of strings that bytes_of takes apart."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])


# --- groups too large for one task -------------------------------------------------------------


def tiled(rows: DataFrame, keys: list[str], ident: list[str], tile: int = TILE, deal: bool = True, work: Workspace | None = None) -> DataFrame:
    """Deal the rows of each group of two or more into tiles of at most about 2 * tile rows.

    A group of m rows is cut into c = ceil(m / tile) parts by a hash of ident, and every pair of
    parts meets in the tile (i, j), i <= j. Adds _i, _j and _own (the row's part). Rows of
    groups of one are gone: they meet nothing. With deal, each tile is in one task, in one run.
    With work, the groups' sizes are staged before they are joined, so that both sides are plain
    shuffles and Spark can split a hot group's rows.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    sizes = work.stage(sizes, "sizes") if work else sizes
    parts = F.ceil(F.col("_m") / tile)
    # rows that a small table explodes into look as small as the table: Spark would send them to the driver and broadcast them
    out = rows.hint("merge").join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64(*ident), parts).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    out = out.select(*rows.columns, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    return dealt(out, keys) if deal else out


def dealt(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Each tile in one task, in one run."""
    by = [*keys, "_i", "_j"]
    return tiles.repartition(*by).sortWithinPartitions(*by)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns as arrays, holding whole runs of equal keys only, and the runs' starts (with the end)."""
    held: list[pa.Table] = []
    rows = 0

    def cut(last: bool):
        nonlocal held, rows
        table = pa.concat_tables(held).combine_chunks()
        columns = {n: table.column(n).to_numpy() for n in table.column_names}
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= columns[k][1:] != columns[k][:-1]
        starts = np.flatnonzero(new)
        end = len(table) if last else int(starts[-1])
        held, rows = ([table.slice(end)], len(table) - end) if end < len(table) else ([], 0)
        starts = np.append(starts[starts < end], end)
        return {n: v[:end] for n, v in columns.items()}, starts

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= least:
                columns, starts = cut(False)
                if len(starts) > 1:
                    yield columns, starts
    if held:
        yield cut(True)


def pairs_in_runs(starts: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], short: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of pairs within a run for which near(a, b) holds: short runs by shifts over all of them at once, long ones row by row."""
    sizes = np.diff(starts)
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= short, sizes)
    at = np.flatnonzero(small)
    for shift in range(1, int(sizes[sizes <= short].max(initial=1))):
        a = at[(at + shift < len(run))]
        a = a[run[a] == run[np.minimum(a + shift, len(run) - 1)]]
        if not len(a):
            break
        at = a
        hit = near(a, a + shift)
        yield a[hit], a[hit] + shift
    for k in np.flatnonzero(sizes > short):
        lo, hi = int(starts[k]), int(starts[k + 1])
        for x in range(lo, hi - 1):
            b = np.arange(x + 1, hi)
            b = b[near(np.full(len(b), x), b)]
            if len(b):
                yield np.full(len(b), x), b


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) that connect what the edges (a, b) connect, one for each node but the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[root])
        while (jump := new[new]) is not None and not np.array_equal(jump, new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014), each a grouped minimum and an
    equi-join, so a node with very many edges is a row for each edge and never a list. The minima
    are staged before they are joined, so that both sides are plain shuffles, and Spark can split
    such a node's rows over tasks. Rounds grow with the logarithm of the longest chain. Each round
    is staged in the shared folder.
    """
    pair = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = work.stage(pair, "edges")
    mark = None
    while (found := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != mark:
        mark = found
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = work.stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = work.stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = work.stage(small.union(least).distinct(), "stars")
        for gone in (now, low, large, least):
            work.drop(gone)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
