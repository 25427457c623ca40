"""Media columns: payloads stored by content in tar shards; rows carry digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import tidy, Workspace
from cartulary.llm.files import Reader, open_store, part_number, written_whole

#: Payloads are padded to whole multiples of so many bytes.
PAD = 64
#: A shard is closed when it holds so many bytes.
SHARD = 64 << 20
#: Members that begin in one stretch of so many bytes are read by one task.
_STRETCH = 1 << 20
#: Bytes from a PNG's start that hold its signature and header chunk.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image of one row of 8-bit samples: lossless, and the same bytes for the same payload.

    One row, as each begins with a byte for its filter, which would break up what repeats.
    """
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, 6)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from a PNG's first HEADER bytes."""
    if start[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", start[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image of to_png."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Sum, sum of squares, turns of direction, and the counts of samples by upper 4 bits."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    slope = np.sign(np.diff(x))
    turns = int((slope[1:] * slope[:-1] < 0).sum())
    return ":".join(map(str, [int(x.sum()), int((x * x).sum()), turns, *np.bincount(x >> 4, minlength=16).tolist()]))


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as an image in tar shards and returns one row for each input row: id, n_bytes, payload_bytes, digest, shard, offset, length.

    A task writes its own shards from its input rows, so no text is shuffled. A member is named by
    its payload's SHA-256 and stands once in the shards of a task, however many rows hold it;
    copies in other tasks are found by the digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        placed: dict[bytes, tuple[str, int, int]] = {}
        shard = writer = out = None
        at = count = 0

        def close():
            out.write(b"\0" * 1024)
            writer.__exit__(None, None, None)

        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = (text.as_py() or "").encode()
                payload = text + b"\0" * (-len(text) % PAD or (0 if text else PAD))
                digest = hashlib.sha256(payload).digest()
                if digest not in placed:
                    if out is not None and at >= SHARD:
                        close()
                        out = None
                    if out is None:
                        shard, at = f"shard-{part_number():06d}-{count:04d}.tar", 0
                        count += 1
                        writer = written_whole(store, f"{root}/{shard}")
                        out = writer.__enter__()
                    media = to_png(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(media)
                    out.write(member.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512))
                    placed[digest] = (shard, at + 512, len(media))
                    at += 512 + len(media) + -len(media) % 512
                rows.append((len(text), len(payload), digest, *placed[digest]))
            if rows:
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            close()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, n_bytes long, payload_bytes long, digest binary, shard string, offset long, length long").withColumnRenamed("id", id_col)


def _in_order(places: DataFrame) -> DataFrame:
    """One place of each digest, in tasks that read a stretch of a shard each."""
    one = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")
    return one.repartition("shard", F.floor(F.col("offset") / F.lit(_STRETCH))).sortWithinPartitions("shard", "offset")


def media_headers(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height and bits of each payload, by reading HEADER bytes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            if batch.num_rows:
                found = [png_header(reader.read(s, o, HEADER)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found))], ["digest", "width", "height", "bits"])
        reader.close()

    return _in_order(places).mapInArrow(tidy(run), "digest binary, width long, height long, bits long")


def media_features(places: DataFrame, folder: str) -> DataFrame:
    """Of each payload, from its stored bytes: payload_sha256, tail_crc32 (of the last PAD bytes), media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                media = reader.read(shard, offset, length)
                payload = from_png(media)
                rows.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows))], ["digest", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        reader.close()

    kinds = "digest binary, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _in_order(places).mapInArrow(tidy(run), kinds)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store_media to a new place in the shared folder, joined with media_headers and media_features: one row for each input row.

    A null or empty text is one row of zeros. Rows of equal texts get equal values. Null ids and
    repeated rows are kept; an empty table gives an empty table.
    """
    work = Workspace(docs.sparkSession, "media")
    folder = work.path("shards")
    rows = work.stage(store_media(docs, folder, id_col, text_col), "rows")
    return rows.join(media_headers(rows, folder), "digest").join(media_features(rows, folder), "digest")
