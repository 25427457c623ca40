"""Quality by compression: the dictionary of good texts and that of bad ones compress a text, and the difference in size is its score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import crc_fold, resident, tidy, Workspace

#: Labelled rows of each label that are looked at, at most; blocks of each label that a dictionary is built from; its bytes; the bytes of a block; the compressor's level.
EXAMPLES, BLOCKS, DICTIONARY, BLOCK, LEVEL = 8_192, 8_192, 112_640, 512, 3


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[k : k + size] for k in range(0, len(text), size)]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """A zstandard dictionary of the samples; where they are too few to train one, the samples themselves, the first of them nearest to what is compressed."""
    try:
        return zstandard.train_dictionary(size, samples, level=level, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed(samples))[-size:]


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """Compresses without header and checksum. Empty dictionaries and those of under eight bytes are none."""
    bare = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**bare)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=held, **bare)


def fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's line for standardised differences, by Newton steps with a weak prior; a constant where only one label is known or the line would fall."""
    none = (0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    if len(set(y.tolist())) < 2 or x.std() == 0:
        return none
    mean, spread = float(x.mean()), float(x.std())
    rows = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), rows.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
    return (float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)) if beta[0] > 0 else none


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    *,
    folds: int = 5,
    held_out: int = 0,
    threshold: float = 0.3,
    examples: int = EXAMPLES,
    samples: int = BLOCKS,
    dictionary: int = DICTIONARY,
    block: int = BLOCK,
    level: int = LEVEL,
) -> DataFrame:
    """One row for each input row: id, held_out, score, predicted, and the evidence: n_bytes, good_bytes, bad_bytes, difference.

    Labels are read only of rows whose crc32(id as text) mod folds is not held_out. The classifier
    is fitted on a bounded sample: of each label the `examples` ids that hash lowest. Half of their
    texts, by a hash of the text, give the dictionaries: of each label the `samples` distinct
    blocks that hash lowest, of all blocks of these texts. The other half fits the line that turns
    a difference into a probability, so no text is judged by a dictionary that holds it.

    A text is compressed block by block with each dictionary, all of it; blocks are short, so that
    what helps is the dictionary and not the text before. The difference is (bytes with the bad
    dictionary - bytes with the good one) / bytes of the text.

    A null or empty text has the difference 0. Null ids are never held out and never examples; an
    id that is labelled both ways, or by another value than 0 and 1, is none. Repeated rows come
    back repeated, and equal texts score alike. Without labels all scores are 0.5, and with one
    label its smoothed rate. An empty table gives an empty table. Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(crc_fold(F.col("id"), folds) != held_out)
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")
    lowest = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(examples)
    chosen = work.stage(lowest(0).unionByName(lowest(1)), "chosen")
    told = rows.join(F.broadcast(chosen), "id").where("text is not null").select("label", "text", (F.xxhash64("text") % 2 == 0).alias("builds"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = blocks(text.as_py(), block)
                for k in range(0, len(own), 4096):
                    part = own[k : k + 4096]
                    keys = np.array([xxhash.xxh64_intdigest(b) for b in part], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array(keys), pa.array(part, pa.binary())], ["label", "key", "block"])

    parts = work.stage(told.where("builds").select("label", "text").mapInArrow(tidy(cut), "label int, key long, block binary").groupBy("label", "key").agg(F.first("block").alias("block")), "blocks")

    def dictionary_of(label: int) -> bytes:
        taken = parts.where(F.col("label") == label).orderBy("key").select("block").limit(samples).collect()  # samples * block bytes at most
        return build_dictionary([bytes(r["block"]) for r in taken], dictionary, level)

    both = spark.sparkContext.broadcast((dictionary_of(1), dictionary_of(0)))
    work.drop(parts)
    this = work.root

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = resident(f"quality {this}", "compressors", lambda: [compressor(d, level) for d in both.value])
        for batch in batches:
            raw, with_good, with_bad = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or b""
                own = blocks(text, block)
                raw[i] = len(text)
                with_good[i] = sum(len(good.compress(b)) for b in own)
                with_bad[i] = sum(len(bad.compress(b)) for b in own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (raw, with_good, with_bad))], ["id", "n_bytes", "good_bytes", "bad_bytes"])

    measured = ", n_bytes long, good_bytes long, bad_bytes long"
    difference = F.when(F.col("n_bytes") > 0, (F.col("bad_bytes") - F.col("good_bytes")) / F.col("n_bytes")).otherwise(F.lit(0.0))
    fitted = told.where("not builds").groupBy("label", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")).select("label", "text")
    pairs = fitted.mapInArrow(tidy(sizes), f"id int{measured}").select("id", difference.alias("x")).orderBy(F.xxhash64("x"), "x", "id").limit(2 * examples).collect()
    x, y = np.array([r["x"] for r in pairs], float), np.array([r["id"] for r in pairs], int)
    slope, shift = fit_line(x, y)

    out = rows.mapInArrow(tidy(sizes), f"id {kind}{measured}").withColumn("difference", difference)
    score = 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("difference") + F.lit(shift))))
    out = out.withColumn("score", score)
    return out.select(F.col("id").alias(id_col), F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_bytes", "good_bytes", "bad_bytes", "difference")
