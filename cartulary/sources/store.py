"""Tables of a store: written whole or appended, and read back. Upserts are a join, a union and an overwrite."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir. Only a local master may go without one: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="store-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write(rows: DataFrame, path: str, mode: str = "overwrite", by: list[str] = (), kind: str = "parquet") -> DataFrame:
    """Rows written to path, and path read again."""
    rows.write.mode(mode).partitionBy(*by).format(kind).save(path)
    return read(rows.sparkSession, path, rows.schema, kind)


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)


def replace_keys(old: DataFrame, new: DataFrame, key: str, path: str) -> DataFrame:
    """What there was, without the keys of what is new, and that; written whole beside the old."""
    return write(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new), path)


def valid_vectors(vectors: DataFrame, dims: int, rows: int | None = None) -> DataFrame:
    """Vectors as they are, if there are `rows` of them and all have `dims` finite components; else an error: a damaged index is not read in part."""
    n, bad = vectors.agg(F.count(F.lit(1)), F.count_if((F.size("embedding") != dims) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))).first()
    if bad or (rows is not None and n != rows):
        raise ValueError(f"vectors are damaged: {bad} of {n} are no {dims} numbers, {rows} expected")
    return vectors
