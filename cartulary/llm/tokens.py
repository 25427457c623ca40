"""Token ids in files of Simple-8b words, and back."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartulary.llm.common import bytes_of, resident, stretches, strings_of, tidy, Workspace
from cartulary.llm.files import Reader, open_store, part_number, written_whole

#: (ids in a word, bits of each) by selector: the selector takes the word's upper 4 bits.
SLOTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20)]
#: Wider ids are escapes: 0 in the word, and (place, id) after the words.
_WIDEST = 20
#: Ids of a block. Blocks decode alone.
BLOCK = 1 << 16
_MAGIC = b"S8B1"


def pack(ids: np.ndarray) -> bytes:
    """A block: numbers of ids, words and escapes; words; escapes' places and ids."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    far = np.flatnonzero(ids >> np.uint32(_WIDEST))
    plain = ids.astype(np.uint64)
    plain[far] = 0
    width = np.zeros(n + 64, np.uint8)  # what a word holds beyond the last id is zeros
    width[:n] = np.frexp(plain.astype(np.float64))[1]
    choice = np.full(n, len(SLOTS) - 1, np.uint8)
    widest, reach = width, 1  # of the next `reach` ids
    for s in range(len(SLOTS) - 2, -1, -1):  # the last that fits is the fullest
        count, bits = SLOTS[s]
        while reach < count:
            step = min(reach, count - reach)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            reach += step
        choice[widest[:n] <= bits] = s
    step = np.array([c for c, _ in SLOTS])[choice].tolist()
    at, k = [], 0
    while k < n:
        at.append(k)
        k += step[k]
    at = np.array(at, np.int64)
    used = choice[at]
    padded = np.concatenate([plain, np.zeros(64, np.uint64)])
    words = used.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SLOTS):
        own = np.flatnonzero(used == s)
        if len(own):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            words[own] |= np.bitwise_or.reduce(padded[at[own][:, None] + np.arange(count)] << shifts, axis=1)
    return struct.pack("<III", n, len(words), len(far)) + words.astype("<u8").tobytes() + far.astype("<u4").tobytes() + ids[far].astype("<u4").tobytes()


def unpack(block: bytes) -> np.ndarray:
    """The ids of a block: words of one selector are taken apart together."""
    n, w, e = struct.unpack_from("<III", block)
    words = np.frombuffer(block, "<u8", w, 12)
    used = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SLOTS])[used]
    start = np.cumsum(counts) - counts
    out = np.zeros(n + 64, np.uint32)
    for s, (count, bits) in enumerate(SLOTS):
        own = np.flatnonzero(used == s)
        if len(own):
            shifts = (np.arange(count) * bits).astype(np.uint64)
            out[start[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[np.frombuffer(block, "<u4", e, 12 + 8 * w)] = np.frombuffer(block, "<u4", e, 12 + 8 * w + 4 * e)
    return out


#: Bytes of text that are encoded at once.
_CHUNK = 6 << 20
#: Words that the library gets in one call, and words whose ids are kept between calls.
_CALL, _KNOWN = 2_000, 400_000
#: Marks after a letter are a piece of their own to the tokenizer; the apostrophe, which contractions begin with, is not among them.
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words:
    """Ids of texts by their words: the tokenizer drops white space and joins nothing across it, so a word's ids are the same everywhere.

    A chunk of texts is split and its distinct words are numbered by Arrow; the library sees each
    word that is not known yet once, many in a call, told apart by their offsets.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.encode = tokenizer.encode
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # whether a token ends a piece
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.size, self.at, self.ids = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii() and w.isalpha()]  # each is one piece
        odd = [w for w in words if not (w.isascii() and w.isalpha())]
        sizes, ids = [self.size], [self.ids]
        for part in (own[k : k + _CALL] for own in (plain, odd) for k in range(0, len(own), _CALL)):
            found = self.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            last = np.flatnonzero(self.ends[ids[-1]]) + 1
            if len(last) == len(part) and part[0].isascii() and part[0].isalpha():
                sizes.append(np.diff(last, prepend=0).astype(np.int32))
            else:
                starts = np.cumsum([0, *(len(w) + 1 for w in part)])
                first = np.array([a for a, _ in found.offsets], np.int64)
                sizes.append(np.bincount(np.searchsorted(starts, first, side="right") - 1, minlength=len(part)).astype(np.int32))
        self.number.update(zip([*plain, *odd], range(len(self.number), len(self.number) + len(words))))
        self.size, self.ids = np.concatenate(sizes), np.concatenate(ids)
        self.at = np.cumsum(self.size, dtype=np.int32) - self.size

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's."""
        column = pa.array(texts, pa.large_string())
        if not any("<|" in t for t in texts):  # an added token's string is one in lower case only
            column = pc.ascii_lower(column)
        split = pc.ascii_split_whitespace(column)
        own = split.flatten().dictionary_encode()
        # a word in two parts: up to its last letter, and marks, if it ends in such
        words = own.dictionary
        data, at = bytes_of(words)
        size = np.diff(at)
        bare = pc.ascii_rtrim(words, characters=_MARKS)
        n = pc.binary_length(bare).to_numpy()
        marked = (n > 0) & (n < size)
        marked[marked] = _LETTER[data[at[:-1][marked] + n[marked] - 1]]
        marked &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(marked), bare, words).dictionary_encode()
        tail = np.concatenate([[0], np.cumsum((size - n)[marked])])
        tails = strings_of(data[stretches((at[:-1] + n)[marked], (size - n)[marked])], tail).dictionary_encode()
        parts = [*stems.dictionary.to_pylist(), *tails.dictionary.to_pylist()]
        if len(self.number) > _KNOWN:
            self._forget()
        new = [*(set(parts) - self.number.keys())]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, parts), np.int32, len(parts))
        code = np.zeros((len(words), 2), np.int32)
        code[:, 0] = number[stems.indices.to_numpy()]
        code[marked, 1] = number[len(stems.dictionary) + tails.indices.to_numpy()]
        known, _ = _taken(self.ids, self.at[code.ravel()], self.size[code.ravel()])
        size = self.size[code].sum(1, dtype=np.int32)
        place = own.indices.to_numpy()
        ids, ends = _taken(known, (np.cumsum(size, dtype=np.int32) - size)[place], size[place])
        to = split.offsets.to_numpy()
        return ids, np.diff(ends[to - to[0]])


def _taken(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of values that begin at `at`, one after the other, and where each ends (with 0 first)."""
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(size, dtype=np.int32)])
    return values[np.arange(ends[-1], dtype=np.int32) + np.repeat(at - ends[:-1], size)], ends


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[int]]]:
    """Ids, pieces of text and the pieces of each id's text: rows of about _CHUNK bytes; longer texts are cut at white space."""
    for batch in batches:
        keys, pieces, counts, size = [], [], [], 0
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py() or ""
            cut = [text] if len(text) <= _CHUNK else _cut(text)
            keys.append(batch.column(0)[i].as_py())
            pieces += cut
            counts.append(len(cut))
            size += len(text)
            if size >= _CHUNK or i + 1 == batch.num_rows:
                yield keys, pieces, counts
                keys, pieces, counts, size = [], [], [], 0


def _cut(text: str) -> list[str]:
    """Pieces of about _CHUNK characters that end before ASCII white space."""
    out, at = [], 0
    while len(text) - at > _CHUNK:
        gap = _GAP.search(text, at + _CHUNK)
        cut = gap.start() if gap else len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


_GAP = re.compile("[\t-\r ]")


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> DataFrame:
    """Writes the ids of all texts, each with end_id after it, in ascending order of id (null first; then by a hash of the text).

    Returns one row for each file: file, docs, ids. A file holds one range of ids: blocks, then the
    documents (id, whether it is null, number of ids), then the blocks' offsets, and a fixed tail.
    The file's range is one task's; ids are gathered a block at a time. vocabulary is the path of a
    tokenizer of the tokenizers library that splits at white space and drops it. An empty table
    gives no file. Ids are whole numbers; others are refused.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is no whole number")
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = _stretches(batches)
        part = next(stretches, None)
        if part is None:
            return
        words = _tokenizer(raw.value)
        store, root = open_store(folder)
        name = f"part-{part_number():06d}.s8b"
        ids, nulls, sizes, offsets, held, at = [], [], [], [], np.zeros(0, np.uint32), 4
        with written_whole(store, f"{root}/{name}") as out:
            out.write(_MAGIC)

            def flush(least: int):
                nonlocal at, held
                done = 0
                while len(held) - done >= least and len(held) > done:
                    block = pack(held[done : done + BLOCK])
                    out.write(block)
                    offsets.append(at)
                    at += len(block)
                    done += BLOCK
                held = held[done:]

            while part is not None:
                keys, pieces, counts = part
                coded, each = words(pieces)
                size = np.add.reduceat(each, np.cumsum(counts) - counts)
                ids += [k or 0 for k in keys]
                nulls += [k is None for k in keys]
                sizes += (size + 1).tolist()
                held = np.concatenate([held, np.insert(coded, np.cumsum(size), np.uint32(end_id))])
                flush(BLOCK)
                part = next(stretches, None)
            flush(1)
            out.write(np.array(ids, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<u4").tobytes() + np.array([*offsets, at], "<u8").tobytes())
            out.write(struct.pack("<QQ", len(ids), len(offsets)) + _MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["file", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    return ordered.mapInArrow(tidy(run), "file string, docs long, ids long")


def _tokenizer(raw: bytes) -> _Words:
    whole = lambda: Tokenizer.from_str(json.dumps(json.loads(raw) | {"truncation": None, "padding": None}))
    return resident("tokens", zlib.crc32(raw), lambda: _Words(whole()))


def read_file(reader: Reader, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(id, ids before it in the file, ids) of each document of a file; a block or two are held at a time."""
    size = reader.size(name)
    docs, blocks = struct.unpack("<QQ", reader.read(name, size - 20, 16))
    tail = docs * 13 + (blocks + 1) * 8
    table = reader.read(name, size - 20 - tail, tail)
    ids = np.frombuffer(table, "<i8", docs).tolist()
    nulls = np.frombuffer(table, "u1", docs, 8 * docs).tolist()
    sizes = np.frombuffer(table, "<u4", docs, 9 * docs).tolist()
    offsets = np.frombuffer(table, "<u8", blocks + 1, 13 * docs).tolist()
    held, block, first = np.zeros(0, np.uint32), 0, 0
    for key, null, n in zip(ids, nulls, sizes):
        parts, have = [held], len(held)
        while have < n:
            parts.append(unpack(reader.read(name, offsets[block], offsets[block + 1] - offsets[block])))
            have += len(parts[-1])
            block += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield None if null else key, first, held[:n]
        held = held[n:]
        first += n


def read_tokens(files: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document in the files of write_tokens: id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    Only the files' sizes are summed on the driver, a row for each file.
    """
    spark = files.sparkSession
    rows, before = [], 0
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        rows.append((r["file"], before))
        before += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, size = [], 0
                for key, first, ids in read_file(reader, name):
                    out.append((key, base + first, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)
        reader.close()

    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(tidy(run), "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "start", "n_tokens", "ids"])


def tokens_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> DataFrame:
    """write_tokens to a new place in the shared folder, then read_tokens of it."""
    work = Workspace(docs.sparkSession, "tokens")
    folder = work.path("files")
    return read_tokens(work.stage(write_tokens(docs, vocabulary, folder, id_col, text_col, end_id=end_id), "manifest"), folder, id_col)
