"""Byte-level BPE by backtracking, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from cartulary.llm.common import resident, tidy

#: White space as Unicode has it. Python's own \s also takes U+001C to U+001F.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs that no piece crosses: a word with the space before it, or white space.
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: Pieces of byte-level BPE (fixed by the vocabulary's pre-tokenizer).
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Characters whose classes every Unicode version agrees on; others are cut by the tokenizers library.
_OLD = re.compile("[\0-\u024f]*")
#: Bytes of a generation of the caches of runs and of pieces, at about _ENTRY beside an entry's own; two generations are kept. Longer keys are not.
_RUNS, _PIECES, _ENTRY, _LONG = 48 << 20, 48 << 20, 160, 1 << 10
#: The same where a worker has little room; between tasks only one generation is kept then.
_LEAN = (28 << 20, 8 << 20)
#: Bytes of text in one output batch.
_BATCH = 4 << 20


class _Cache(dict):
    """A dictionary that fills itself, and forgets what was not asked for in the last two generations."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.older, self.size, self.room = make, {}, size, size

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > _LONG:
            return value
        self.room -= len(key) + len(value) + _ENTRY
        if self.room < 0:
            self.older, self.room = dict(self), self.size
            self.clear()
        self[key] = value
        return value


def _byte_chars() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BacktrackingBPE:
    """Exact BPE without running merges.

    A sequence of tokens is what the merges give if and only if each neighbouring pair is what the
    merges give for that pair. So: take the longest token that matches (all matches of a piece
    come from one Aho-Corasick pass), keep it if it is compatible with the token before it, else
    try its next shorter prefix; without one, go back a token and never come here again. Each
    position is left for good at most once, so the work is linear in the piece.
    Tokens are numbered by rank: bytes first, then merges in order.
    """

    def __init__(self, raw: bytes, runs: int = _RUNS, pieces: int = _PIECES):
        spec = json.loads(raw)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        text = lambda token: "".join(chr(chars[c]) for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        names = [*chars, *(a + b for a, b in merges)]
        self.tokens = [text(n) for n in names]
        self.ids = [vocab[n] for n in names]
        self.rank: dict[str, int] = {}
        for r, t in enumerate(self.tokens):
            self.rank.setdefault(t, r)
        self.size = [len(t) for t in self.tokens]
        self.split = [(r, r) for r in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            pair = (self.rank[text(a)], self.rank[text(b)])
            self.split.append(pair)
            self.merged.setdefault(pair, 256 + k)
        self.prefix = [next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1) for t in self.tokens]
        self.matches = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.matches.add_word(t, r)
        self.matches.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        table = {i: t.encode("latin-1") for i, t in zip(self.ids, self.tokens)} | {i: t.encode() for t, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.compatible = lru_cache(1 << 16)(self._compatible)
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.chars = str.maketrans({c: chr(b) for c, b in chars.items()})
        self.pieces = _Cache(self._encode_piece, pieces)
        self.chunks = _Cache(self._encode_chunk, runs)

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges, run over the bytes of left and right together, keep the border between them.

        Undo both tokens' merges, the latest first; if the two parts that then touch would merge
        before the merge just undone, the border would not have lasted.
        """
        limit = len(self.split)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            for _ in range(2):
                if left > right and self.split[left][1] != left:
                    limit, left = left, self.split[left][1]
                    break
                if self.split[right][0] != right:
                    limit, right = right + 1, self.split[right][0]
                    break
                if self.split[left][1] != left:
                    limit, left = left, self.split[left][1]
                    break
            else:
                return True
            continue

    def _encode_piece(self, piece: str) -> bytes:
        whole = self.rank.get(piece)
        if whole is not None:
            return self.ids[whole].to_bytes(4, "little")
        n, size, prefix, compatible = len(piece), self.size, self.prefix, self.compatible
        longest = [0] * n
        for end, r in self.matches.iter(piece):
            longest[end + 1 - size[r]] = r  # ends only rise, so the longest of a start comes last
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_at[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= size[token]
        ids = self.ids
        return np.array([ids[r] for r in out], "<u4").tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        pieces = self.pieces
        if not _OLD.fullmatch(chunk):
            return b"".join([pieces[p.translate(self.chars)] for p, _ in self.cut(chunk)])
        return b"".join([pieces[p.encode("utf-8").decode("latin-1")] for p in _PIECE.findall(chunk)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunk = self.chunks.__getitem__
        if self._special and self._special.search(text):
            parts = self._special.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else b"".join(map(chunk, _CHUNK.findall(p))) for k, p in enumerate(parts))
        return b"".join(map(chunk, _CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids: each id's slice of one table of bytes, found by its offset."""
        out = []
        for k in range(0, len(ids), 1 << 20):
            i = np.frombuffer(ids[k : k + (1 << 20)], "<u4")
            start = self.offsets[i]
            size = self.offsets[i + 1] - start
            end = np.cumsum(size)
            out.append(self.blob[np.arange(end[-1]) + np.repeat(start - end + size, size)].tobytes())
        return b"".join(out)


def _load(raw: bytes, lean: bool) -> BacktrackingBPE:
    return resident("bpe", (hashlib.sha1(raw).hexdigest(), lean), lambda: BacktrackingBPE(raw, *(_LEAN if lean else ())))


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), *, lean: bool = False) -> DataFrame:
    """One row for each input row: id, the columns to carry, n_tokens, ids (little-endian unsigned 32-bit) and decoded (the text of the ids).

    A column to carry that has the name of the id or of a result gives way to it. lean keeps smaller
    caches, for a worker that has run other operators: less memory for a third more time.

    vocabulary is the path of a byte-level BPE file; the file (a few MB, whatever the data) is
    broadcast. Strings of its added tokens in a text become their ids. A null or empty text has no
    ids and decodes to the empty text. Rows are independent: there is no shuffle, ids may be null
    or repeat, and an empty table gives an empty table. Bytes that are not UTF-8 after decoding
    become U+FFFD.
    """
    carry = [c for c in carry if c not in (id_col, "n_tokens", "ids", "decoded")]
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(raw.value, lean)
        for batch in batches:
            ids: list[bytes] = []
            size = first = 0
            for i in range(batch.num_rows):
                ids.append(bpe.encode(batch.column(1)[i].as_py()))
                size += len(ids[-1])
                if size >= _BATCH or i + 1 == batch.num_rows:
                    decoded = [bpe.decode(x).decode("utf-8", "replace") for x in ids]
                    counts = [len(x) // 4 for x in ids]
                    kept = [batch.column(0), *batch.columns[2:]]
                    arrays = [*(c.slice(first, len(ids)) for c in kept), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    ids, size, first = [], 0, i + 1
        if lean:
            bpe.pieces.older, bpe.chunks.older = {}, {}

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(carry)])
    kinds = {f: rows.schema[f].dataType.simpleString() for f in rows.columns if f != "_text"}
    names = [*kinds, "n_tokens", "ids", "decoded"]
    out = rows.mapInArrow(tidy(run), ", ".join(f"`{f}` {k}" for f, k in kinds.items()) + ", n_tokens long, ids binary, decoded string")
    return out.toDF(id_col, *carry, "n_tokens", "ids", "decoded")
