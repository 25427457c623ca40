"""LM scoring by prediction by partial matching over bytes, beside a word model as base."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import crc_fold, tidy, Workspace
from cartulary.llm.files import open_store

#: Bytes of context. With the predicted byte they fill 48 bits, which leaves 16 for a document's number in its chunk.
ORDER = 5
#: The byte that ends a text and stands before its start: UTF-8 has none such.
_END = b"\xff"
#: Bytes of text worked on at once, and documents at most; bytes for which the model is asked at once.
_CHUNK, _DOCS, _STRETCH = 1 << 20, 1 << 16, 20 << 20
#: Entries of a model's slice, which one task holds at once, judged by the bytes of text; slices at most.
SLICE, _SLICES = 500_000, 4096
#: Entries gathered in a task before they are sent on.
_GATHERED = 2_000_000
_FOLD = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_RANDOM = np.random.default_rng(20_240_229)
_TABLE = _RANDOM.integers(0, 1 << 64, (64, 256), np.uint64)
_MIX = _RANDOM.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
#: The key of the token that ends a text.
END = int(_RANDOM.integers(0, 1 << 63))


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word in order, and where it starts.

    A key is the sum of random numbers drawn for (place, byte): tabulation hashing, so two words of
    up to 64 bytes share a key with probability 2 ** -64. Beyond, a place's numbers are those of
    place % 64, times an odd number mixed from place // 64; a word's first 64 bytes count the same
    whether or not a longer word is near.
    """
    text = np.frombuffer(data.translate(_FOLD), np.uint8)
    inside = ~_SPACE[text]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    place = at - np.repeat(starts, np.diff(np.append(first, len(at))))
    drawn = _TABLE[place & 63, text[at]]
    if place.max() > 63:
        turn = (place >> 6).astype(np.uint64) * _MIX[0]
        turn = ((turn ^ (turn >> np.uint64(29))) * _MIX[1]) | np.uint64(1)
        drawn = np.where(place > 63, drawn * turn, drawn)
    return np.add.reduceat(drawn, first), starts


def gram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end, the ORDER bytes before it and it as one number; and the text's number.

    A text begins after ORDER times the byte that ends it.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    own = np.ones(sizes.sum() + ORDER * (len(texts) - 1), bool)
    starts = np.cumsum(sizes + ORDER)[:-1] - ORDER
    for k in range(ORDER):  # what ends at a byte before a text's start
        own[starts + k] = False
    return _codes(b"".join([_END * ORDER + t + _END for t in texts]))[own], np.repeat(np.arange(len(texts)), sizes)


def _codes(data: bytes) -> np.ndarray:
    """The numbers of ORDER + 1 bytes that begin at each byte: eight bytes, without the last two."""
    n = len(data) - ORDER
    return np.ndarray((n,), ">u8", data + b"\0\0", strides=(1,)).astype(np.uint64) >> np.uint64(16)


def gram_units(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """gram_codes in parts: the texts of up to _CHUNK bytes together, each longer one in pieces."""
    short = [k for k, t in enumerate(texts) if len(t) <= _CHUNK]
    if short:
        code, doc = gram_codes([texts[k] for k in short])
        yield code, np.array(short)[doc]
    for k in set(range(len(texts))) - set(short):
        for at in range(0, len(texts[k]) + 1, _CHUNK):
            before = texts[k][at - ORDER : at] if at else _END * ORDER
            part = before + texts[k][at : at + _CHUNK] + (_END if at + _CHUNK > len(texts[k]) else b"")
            code = _codes(part)
            yield code, np.full(len(code), k)


def word_units(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the texts' words and each one's text, in the same parts."""
    short = [k for k, t in enumerate(texts) if len(t) <= _CHUNK]
    if short:
        key, start = word_keys(b" ".join([texts[k] for k in short]))
        ends = np.cumsum([len(texts[k]) + 1 for k in short])
        yield key, np.array(short)[np.searchsorted(ends, start, side="right")] if len(start) else start
    for k in set(range(len(texts))) - set(short):
        for piece in _pieces(texts[k]):
            key = word_keys(piece)[0]
            yield key, np.full(len(key), k)


def _pieces(text: bytes) -> list[bytes]:
    """A text of more than _CHUNK bytes in pieces that end after white space, if there is any; else whole."""
    out, at = [], 0
    while len(text) - at > _CHUNK:
        cut = next((k for k in range(at + _CHUNK, len(text)) if text[k] in b" \t\n\v\f\r"), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Texts of up to _DOCS rows and about _CHUNK bytes, and the rows' other columns."""
    for batch in batches:
        column, other = batch.column(1).cast(pa.binary()), batch.drop_columns([batch.schema.names[1]])
        texts, size, first = [], 0, 0
        for i in range(batch.num_rows):
            texts.append(column[i].as_py() or b"")
            size += len(texts[-1])
            if size >= _CHUNK or len(texts) == _DOCS or i + 1 == batch.num_rows:
                yield other.slice(first, len(texts)), texts
                texts, size, first = [], 0, i + 1


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, compressed: the upper bytes of small ones cost nothing."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(-1, 8).T.copy(), codec="zstd", asbytes=True)


def _from_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(8, n).T.copy().view(np.uint64).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data), dtype=np.uint64)


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *n])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    starts = _runs(keys)
    return keys[starts], np.add.reduceat(n, starts) if len(starts) else n


def _by_slice(kind: int, keys: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """The keys' slices, and where each one's keys are, in order."""
    which = _which(kind, keys, slices).astype(np.int64)
    order = np.argsort(which, kind="stable")
    starts = _runs(which[order])
    for a, b in zip(starts, np.append(starts[1:], len(keys))):
        yield int(which[order[a]]), order[a:b]


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about size bytes."""
    held, held_size = [], 0
    for row in rows:
        held.append(row)
        held_size += 64 + sum(len(x) for x in row if isinstance(x, (bytes, list)))
        if held_size >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))
            held, held_size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], list(kinds))


_COUNTS = {"kind": pa.int32(), "slice": pa.int64(), "keys": pa.binary(), "n": pa.binary()}


def gather(batches: Iterator[pa.RecordBatch], slices: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(kind, slice, keys, n): how often the task's texts hold each word (kind 0) and each gram (kind 1), a row for each slice."""

    def rows() -> Iterator[tuple]:
        counts: list[tuple[list, list]] = [([], []), ([], [])]
        ends = waiting = 0

        def out(kind: int, least: int) -> Iterator[tuple]:
            keys, n = _summed(*counts[kind])
            counts[kind] = ([keys], [n])
            if len(keys) >= least:
                counts[kind] = ([], [])
                for k, own in _by_slice(kind, keys, slices[kind]):
                    yield kind, k, _packed(keys[own]), _planes(n[own])

        for _, texts in _chunks(batches):
            ends += len(texts)
            waiting += sum(map(len, texts))
            for kind, units in enumerate((word_units, gram_units)):
                for keys, _ in units(texts):
                    keys = np.sort(keys)
                    starts = _runs(keys)
                    counts[kind][0].append(keys[starts])
                    counts[kind][1].append(np.diff(np.append(starts, len(keys))))
            if waiting >= 8 * _CHUNK:
                waiting = 0
                for kind in (0, 1):
                    yield from out(kind, _GATHERED)
        if ends:
            counts[0][0].append(np.array([END], np.uint64))
            counts[0][1].append(np.array([ends]))
        for kind in (0, 1):
            yield from out(kind, 1)

    return _batches(rows(), _COUNTS)


_MODEL = {"kind": pa.int32(), "slice": pa.int64(), "keys": pa.binary(), "n": pa.binary(), "v": pa.int64(), "total": pa.int64(), "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each slice: its keys and their sums over the tasks, their number and total, and the counts of its grams' last two bytes."""

    def done(kind: int, k: int, held: tuple[list, list]) -> tuple:
        keys, n = held if len(held[0]) == 1 else _summed(*held)
        keys, n = (keys[0], n[0]) if isinstance(keys, list) else (keys, n)
        pairs, of = np.unique(keys & np.uint64(0xFFFF), return_inverse=True) if kind else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return kind, k, _packed(keys), _planes(n), len(keys), int(n.sum()), pairs.astype(np.int64).tolist(), np.bincount(of, n, len(pairs)).astype(np.int64).tolist()

    def rows() -> Iterator[tuple]:
        at, held, size = None, ([], []), 0
        for batch in batches:
            for i in range(batch.num_rows):
                kind, k, keys, n = (batch.column(c)[i].as_py() for c in range(4))
                if (kind, k) != at:
                    if at is not None:
                        yield done(*at, held)
                    at, held, size = (kind, k), ([], []), 0
                held[0].append(_unpacked(keys))
                held[1].append(_from_planes(n).view(np.int64))
                size += len(held[0][-1])
                if size > 2 * len(held[0][0]) + _GATHERED:  # what came first has been summed already
                    held = tuple([x] for x in _summed(*held))
                    size = len(held[0][0])
        if at is not None:
            yield done(*at, held)

    return _batches(rows(), _MODEL)


class Trie:
    """A slice of the byte-context trie: the grams whose two bytes before the last lie in the slice, and all shorter contexts of theirs.

    Level k holds contexts of k bytes as sorted numbers. Escapes are PPM method C: a context of
    which q symbols are not yet excluded escapes with weight q against their counts. What a longer
    context has seen is excluded in the shorter one; since it was seen there too, the sums over
    excluded symbols are one number for each context, kept beside it.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(code)
        self.grams: list = [None] * (ORDER + 1)
        self.grams[ORDER] = (code[order], n[order])
        for k in range(ORDER - 1, 1, -1):
            self.grams[k] = self._suffixes(*self.grams[k + 1], k)
        self.grams[1] = pairs
        self.grams[0] = self._suffixes(*pairs, 0)
        self.contexts = []
        for k in range(ORDER + 1):
            code, n = self.grams[k]
            context = code >> np.uint64(8)
            starts = _runs(context)
            seen = np.diff(np.append(starts, len(code)))
            total = np.add.reduceat(n, starts) if len(starts) else n
            below = np.add.reduceat(self.count(k - 1, code & self._mask(k - 1)), starts) if k and len(starts) else np.zeros(len(starts), np.int64)
            self.contexts.append((context[starts], total, seen, below))

    @staticmethod
    def _mask(k: int) -> np.uint64:
        return np.uint64((1 << 8 * (k + 1)) - 1)

    def _suffixes(self, code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        short = code & self._mask(k)
        order = np.argsort(short, kind="stable")
        short, n = short[order], n[order]
        starts = _runs(short)
        return short[starts], np.add.reduceat(n, starts) if len(starts) else n

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def count(self, k: int, code: np.ndarray) -> np.ndarray:
        at, hit = self._find(self.grams[k][0], code)
        return np.where(hit, self.grams[k][1][at] if len(self.grams[k][1]) else 0, 0)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        gone, symbols = np.zeros(len(code)), np.zeros(len(code))  # counts and symbols excluded here
        for k in range(ORDER, -1, -1):
            own = code[left] & self._mask(k)
            contexts, total, seen, below = self.contexts[k]
            at, known = self._find(contexts, own >> np.uint64(8))
            if len(contexts):
                rest = np.where(known, total[at] - gone, 0.0)
                fresh = np.where(known, seen[at] - symbols, 0.0)
            else:
                rest = fresh = np.zeros(len(left))
            n = self.count(k, own)
            live = fresh > 0
            hit = live & (n > 0)
            out[left[hit]] += np.log10(n[hit] / (rest[hit] + fresh[hit]))
            escaped = live & ~hit
            out[left[escaped]] += np.log10(fresh[escaped] / (rest[escaped] + fresh[escaped]))
            if len(contexts):
                gone, symbols = np.where(known, below[at], gone), np.where(known, seen[at], symbols)
            keep = ~hit
            left, gone, symbols = left[keep], gone[keep], symbols[keep]
            if not len(left):
                return out
        out[left] -= np.log10(np.maximum(256 - symbols, 1))
        return out


def _which(kind: int, key: np.ndarray, slices: int) -> np.ndarray:
    """The slice that a key's entry lies in: a word's by some of its bits, a gram's by the two bytes before its last."""
    if kind:
        return (((key >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40_503) >> np.uint64(8)) % np.uint64(slices)
    return ((key >> np.uint64(20)) & np.uint64(0x7FFFFFFF)) % np.uint64(slices)


def _rows_in(folder: str, columns: list[str]) -> pa.Table | None:
    """The Parquet files of a folder, if there is one."""
    store, path = open_store(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    return ds.dataset(path, filesystem=store, format="parquet").to_table(columns=columns)


class Model:
    """The model in the shared folder, a slice at a time."""

    def __init__(self, root: str, slices: tuple[int, int], pairs: tuple[np.ndarray, np.ndarray]):
        self.root, self.slices, self.pairs = root, slices, pairs
        self.at, self.held = None, None

    def answer(self, kind: int, k: int, keys: np.ndarray) -> np.ndarray:
        """Counts of words, or log10 probabilities of grams, of keys that lie in slice k. Of neighbouring calls for one slice, the first reads it."""
        if self.at != (kind, k):
            self.held = None
            table = _rows_in(f"{self.root}/kind={kind}/slice={k}", ["keys", "n"])
            own = (_unpacked(table["keys"][0].as_py()), _from_planes(table["n"][0].as_py()).view(np.int64)) if table else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            self.at, self.held = (kind, k), Trie(*own, self.pairs) if kind else own
        if kind:
            return self.held.log10(keys)
        at, hit = Trie._find(self.held[0], keys)
        return np.where(hit, self.held[1][at] if len(self.held[1]) else 0, 0).astype(np.float64)

    def all(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The same for keys of any slice."""
        out, which = np.zeros(len(keys)), _which(kind, keys, self.slices[kind])
        for k in np.unique(which).tolist():
            out[which == k] = self.answer(kind, k, keys[which == k])
        return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[pa.RecordBatch, list[bytes]]]]]:
    """Chunks of about _STRETCH bytes together, and a number that is drawn from all their ids and texts."""
    held, size, mark = [], 0, xxhash.xxh64()
    for batch, texts in _chunks(batches):
        held.append((batch, texts))
        mark.update(repr(batch.column(0).to_pylist()).encode())
        for t in texts:
            mark.update(len(t).to_bytes(8, "little"))
            mark.update(t)
            size += len(t)
        if size >= _STRETCH:
            yield mark.intdigest() >> 1, held
            held, size, mark = [], 0, xxhash.xxh64()
    if held:
        yield mark.intdigest() >> 1, held


def _distinct(parts: Iterator[np.ndarray]) -> np.ndarray:
    held, size = [], 0
    for keys in parts:
        held.append(_once(keys))
        size += len(held[-1])
        if size > _GATHERED:
            held = [_once(np.concatenate(held))]
            size = 0
    return _once(np.concatenate([np.zeros(0, np.uint64), *held]))


def _once(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_runs(keys)]


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows but those whose crc32(id as text) mod folds is held_out. Each
    task counts its own words and grams and sends the counts, packed, to the tasks that own their
    slices; their sums are written to the shared folder. Each task then sends the distinct words and
    grams of each stretch of its texts to the tasks that own their slices, which read a slice once
    and write the answers beside each other by stretch; and a last pass over the texts, where they
    lie, reads the answers of its stretches. So each entry of the model is read once, memory is
    bounded by a slice or a stretch, and no text is shuffled. A stretch is known by its ids and
    texts; were rows dealt to tasks anew in between, as after the loss of executors, its answers
    are not found, and the task asks the slices itself. A table that is not read plainly from files
    is staged first, so that rows come in one order.

    base_score sums log10((c + 1) / (N + V + 1)) over the words and one end of each text; score is
    the log10 probability of the text's bytes and end under PPM with ORDER bytes of context.
    A null or empty text has the end alone. Null ids are training rows. Repeated rows count and
    come back repeated. Without training rows base_score is 0 and score that of equal bytes. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ppm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if re.search("Exchange|InMemoryTableScan|Scan ExistingRDD|LocalTableScan", rows._jdf.queryExecution().executedPlan().toString()):
        rows = work.stage(rows, "rows")
    rows = rows.withColumn("held_out", F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grams = min(_SLICES, max(1, -(-size // (24 * SLICE))))
    slices = (max(1, grams // 4), grams)
    by = lambda df: df.repartition(2 * sum(slices), "kind", "slice").sortWithinPartitions("kind", "slice")
    root, answers = work.path("model"), work.path("answers")
    counted = rows.where("not held_out").select("id", "text").mapInArrow(tidy(lambda batches: gather(batches, slices)), "kind int, slice long, keys binary, n binary")
    by(counted).mapInArrow(tidy(merge), "kind int, slice long, keys binary, n binary, v long, total long, pairs array<long>, counts array<long>").write.partitionBy("kind", "slice").parquet(root)
    model = spark.read.schema("keys binary, n binary, v long, total long, pairs array<long>, counts array<long>, kind int, slice long").parquet(root)
    sizes = {r["kind"]: (r["v"], r["n"]) for r in model.groupBy("kind").agg(F.sum("v").alias("v"), F.sum("total").alias("n")).collect()}
    (words, tokens), (grams, _) = sizes.get(0, (0, 0)), sizes.get(1, (0, 0))
    # the last two bytes of all grams: 65,536 rows at most
    low = model.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("code")).agg(F.sum("p.counts").alias("n")).orderBy("code").collect()
    pairs = (np.array([r["code"] for r in low], np.uint64), np.array([r["n"] for r in low], np.int64))
    both = rows.select("id", "text", "held_out")
    buckets = max(1, both.rdd.getNumPartitions())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked() -> Iterator[tuple]:
            for mark, held in _stretches(batches):
                for kind, units in enumerate((word_units, gram_units)):
                    keys = _distinct(keys for _, texts in held for keys, _ in units(texts))
                    keys = _once(np.append(keys, np.uint64(END))) if kind == 0 else keys
                    for k, own in _by_slice(kind, keys, slices[kind]):
                        yield kind, k, mark, _packed(keys[own])

        return _batches(asked(), {"kind": pa.int32(), "slice": pa.int64(), "mark": pa.int64(), "keys": pa.binary()})

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def replies() -> Iterator[tuple]:
            model = Model(root, slices, pairs)
            for batch in batches:
                for i in range(batch.num_rows):
                    kind, k, mark, packed = (batch.column(c)[i].as_py() for c in range(4))
                    yield kind, mark, packed, _planes(model.answer(kind, k, _unpacked(packed)))

        return _batches(replies(), {"kind": pa.int32(), "mark": pa.int64(), "keys": pa.binary(), "answers": pa.binary()})

    replied = by(both.mapInArrow(tidy(ask), "kind int, slice long, mark long, keys binary")).mapInArrow(tidy(reply), "kind int, mark long, keys binary, answers binary").withColumn("bucket", F.col("mark") % buckets)
    replied.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(answers)

    def known(mark: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The answers of a stretch, as far as there are any."""
        table = _rows_in(f"{answers}/bucket={mark % buckets}", ["kind", "mark", "keys", "answers"])
        table = table.filter((pc.field("mark") == mark) & (pc.field("kind") == kind)) if table is not None else None
        if not table:
            return np.zeros(0, np.uint64), np.zeros(0)
        keys = [_unpacked(k) for k in table.column("keys").to_pylist()]
        value = [_from_planes(v).view(np.float64) for v in table.column("answers").to_pylist()]
        keys, value = np.concatenate(keys), np.concatenate(value)
        order = np.argsort(keys)
        return keys[order], value[order]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(root, slices, pairs)
        for mark, held in _stretches(batches):
            answered = known(mark, 0), known(mark, 1)

            def values(kind: int, keys: np.ndarray) -> np.ndarray:
                at, hit = Trie._find(answered[kind][0], keys)
                if hit.all():
                    return answered[kind][1][at]
                return model.all(kind, keys)

            for batch, texts in held:
                n = len(texts)
                count, seen, base, ppm = (np.zeros(n) for _ in range(4))
                units = [*word_units(texts), (np.full(n, END, np.uint64), np.arange(n))]
                key, doc = (np.concatenate(x) for x in zip(*units))
                order = np.argsort(key)
                key, doc = key[order], doc[order]
                starts = _runs(key)
                found = values(0, key[starts]) if words else np.zeros(len(starts))
                each = np.repeat(found, np.diff(np.append(starts, len(key))))
                count += np.bincount(doc, minlength=n)
                seen += np.bincount(doc, each > 0, n)
                if tokens:
                    base += np.bincount(doc, np.log10((each + 1) / (tokens + words + 1)), n)
                for code, owner in gram_units(texts):
                    packed = np.sort((code << np.uint64(16)) | owner.astype(np.uint64))
                    code = packed >> np.uint64(16)
                    starts = _runs(code)
                    value = values(1, code[starts]) if grams else np.full(len(starts), -math.log10(256))
                    ppm += np.bincount((packed & np.uint64(0xFFFF)).astype(np.int64), np.repeat(value, np.diff(np.append(starts, len(code)))), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x) for x in (count.astype(np.int64), seen.astype(np.int64), base, ppm))], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(tidy(score), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
