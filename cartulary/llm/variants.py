"""Spelling variants: automata of halves of words find the words that one edit apart share one; the commonest near word is the form."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import pieces, stretches, tidy, tiled, whole_runs, Workspace

#: Code points and occurrences that a word has at least; of so many runs one loses a code point; a form is so many times as common.
LEAST_LENGTH, LEAST_COUNT, ONE_IN, TIMES = 7, 2, 31, 10
#: Code points of the key of a shard: no more than the shorter half of a word has. Words of an automaton's shard, about, and candidates compared at once.
_KEY, _SHARD, _AT_ONCE = 3, 16_384, 1 << 20
_ENTRIES = 400_000
_FOLD = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 0xC0 else 32 for c in range(256))


def _run_counts(least: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n) of the runs of letters, of which one in `one_in` has lost a code point. In Latin-1 a letter is a byte, and what it lacks is no letter."""
        held: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            yield from (batch.slice(k, 1 << 16) for k in range(0, len(words), 1 << 16))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begun = zlib.crc32(f"{key or ''}:".encode())
                for piece in pieces((text.as_py() or "").encode("latin-1", "replace").translate(_FOLD)):
                    for w, n in Counter(x for x in piece.split() if len(x) >= least).items():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                        if h % one_in == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least:
                                continue
                        held[w] += n
                if len(held) > _ENTRIES:
                    yield from sent()
                    held.clear()
        yield from sent()

    return run


def _common(codes: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many code points are equal from the places a and b on, in one direction, `most` at most."""
    n = np.zeros(len(a), np.int64)
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[codes[a[live] + k * step] == codes[b[live] + k * step]]
        n[live] += 1
        k += 1
        live = live[most[live] > k]
    return n


class Words:
    """Words by their code points (one byte each), for comparisons of many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.has = np.bitwise_or.reduceat(np.uint64(1) << (self.codes & np.uint8(63)).astype(np.uint64), self.at) if len(words) else np.zeros(0, np.uint64)

    def shared_start(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _common(self.codes, self.at[a], self.at[b], np.minimum(self.size[a], self.size[b]), 1)

    def shared_end(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return _common(self.codes, self.at[a] + self.size[a] - 1, self.at[b] + self.size[b] - 1, most, -1)


def candidates(words: Words, rows: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, each once, of which one word has the first (or last) half of the other at its start (end), and whose lengths differ by one at most.

    The automaton holds the halves of all words; each word is scanned for them. A half of k code
    points is that of words of two lengths, m and m + 1: its own words meet those of it that stand
    after them in the order of length, and words of m - 1 meet its words of m.
    """
    size = words.size[rows]
    half = size // 2 if first else size - size // 2
    text = [words.words[i] for i in rows.tolist()]
    number: dict[str, int] = {}
    segment = np.fromiter((number.setdefault(w[:k] if first else w[-k:], len(number)) for w, k in zip(text, half.tolist())), np.int64, len(text))
    order = np.lexsort((size, segment))
    row, size, half, segment = rows[order], size[order], half[order], segment[order]
    lo = np.searchsorted(segment, np.arange(len(number)))
    hi = np.searchsorted(segment, np.arange(len(number)), "right")
    length = half[lo]
    shorter = 2 * length if first else 2 * length - 1
    middle = lo + np.add.reduceat(size == shorter[segment], lo)
    machine = ahocorasick.Automaton()
    for k, v in number.items():
        machine.add_word(k, v)
    machine.make_automaton()
    place, met = [], []
    for at, w in enumerate(text[i] for i in order.tolist()):
        m, k = len(w), int(half[at]) + 1
        for end, s in machine.iter(w, 0, min(k, m)) if first else machine.iter(w, max(m - k, 0), m):
            if end == length[s] - 1 if first else end == m - 1:
                place.append(at)
                met.append(s)
    place, met = np.array(place, np.int64), np.array(met, np.int64)
    own = met == segment[place]
    longer = ~own & (shorter[met] == size[place] + 1)
    begin = np.where(own, place + 1, lo[met])
    many = np.where(own, hi[met] - place - 1, np.where(longer, middle[met] - lo[met], 0))
    ends, at = np.cumsum(many), 0
    while at < len(many):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _AT_ONCE, "right")), at + 1)
        a, b = row[np.repeat(place[at:stop], many[at:stop])], row[stretches(begin[at:stop], many[at:stop])]
        yield a, b
        at = stop


def near_pairs(words: Words, rows: np.ndarray, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates that are one edit apart. What the first halves find, the last do not give again."""
    for a, b in candidates(words, rows, first):
        like = np.bitwise_count(words.has[a] ^ words.has[b]) <= 2  # an edit adds and takes away one letter at most
        a, b = a[like], b[like]
        most = np.maximum(words.size[a], words.size[b])
        start = words.shared_start(a, b)
        rest = np.minimum(words.size[a], words.size[b]) - start
        near = start + words.shared_end(a, b, rest) >= most - 1
        if not first:
            near &= start < most // 2
        yield a[near], b[near]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, most, form): for each word of a tile how many near words it has there, and the commonest of them."""
    for columns, starts in whole_runs(batches, ["side", "key", "_i", "_j"]):
        words, n, own = Words(columns["word"].tolist()), columns["n"], columns["_own"]
        found = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            across = columns["_i"][lo] != columns["_j"][lo]
            for a, b in near_pairs(words, np.arange(lo, hi), columns["side"][lo] == 0):
                keep = own[a] != own[b] if across else slice(None)
                found.append((a[keep], b[keep]))
        if not any(len(a) for a, _ in found):
            continue
        a, b = (np.concatenate(x) for x in zip(*found))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        _, rank = np.unique(columns["word"][b].astype(str), return_inverse=True)
        order = np.lexsort((rank, -n[b], a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(columns["word"][a[at]], pa.string()), pa.array(np.diff(np.append(at, len(a)))), pa.array(n[b[at]]), pa.array(columns["word"][b[at]], pa.string())], ["word", "near", "most", "form"])


def count_words(docs: DataFrame, id_col: str, text_col: str, least: int, one_in: int) -> DataFrame:
    """(word, n) of all words that occur LEAST_COUNT times or more."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_run_counts(least, one_in)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST_LENGTH, one_in: int = ONE_IN, times: int = TIMES, shard: int = _SHARD) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters with A-Z lower-cased, of `least` code points and more (7 is the
    least that there is) and two occurrences; one run in `one_in`, by the crc32 of id and run, has
    lost a code point. Two words are near if one inserted, deleted or replaced code point makes
    them equal; they then share the first or the last half of the longer one, at the same end. The
    halves are dealt to shards by their three code points at the end of the word, words by theirs,
    so that each word is scanned by the two shards that can hold a half of it; a shard of more than
    about 2 * shard words is dealt in tiles. A shard's automaton finds the halves, whose offsets
    and lengths are checked, and the candidates are compared by code points. A task sends on counts
    and the best form of each word, never pairs.

    A word's form is the commonest of its near words, of equals the first in code-point order, if
    it is `times` times as common or more. Forms grow by that factor from one to the next, so the
    chains are short; root is the last of a word's chain, or the word itself. Null texts have no
    runs; a null id reads as the empty text. Repeated rows count again. Other columns are ignored,
    and an empty table gives an empty table.
    """
    if least < LEAST_LENGTH:
        raise ValueError(f"halves of words of under {LEAST_LENGTH} code points are shorter than a shard's key")
    work = Workspace(docs.sparkSession, "variants")
    words = work.stage(count_words(docs, id_col, text_col, least, one_in), "words")
    side = lambda k, key: F.struct(F.lit(k).alias("side"), key.alias("key"))
    dealt = words.select("word", "n", F.inline(F.array(side(0, F.left("word", F.lit(_KEY))), side(1, F.right("word", F.lit(_KEY))))))
    near = tiled(dealt, ["side", "key"], ["word"], shard, work=work).mapInArrow(tidy(_near), "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("o"), "form")).alias("best")
    near = near.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.o")).alias("most"), F.col("best.form").alias("form"))
    wins = F.col("most") >= times * F.col("n")
    known = work.stage(known.select("word", F.when(wins, F.col("form")).alias("form"), "n", "n_near", F.when(wins, F.col("most")).alias("form_n")), "known")
    roots = work.stage(known.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps that root stands for
        beyond = roots.select(F.col("word").alias("_at"), F.col("root").alias("_beyond"))
        new = work.stage(roots.join(beyond, roots.root == beyond._at, "left").select("word", F.coalesce("_beyond", "root").alias("root"), F.col("_at").isNotNull().alias("moved")), "roots")
        work.drop(roots)
        roots = new
        if roots.where("moved").isEmpty():
            break
    return known.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in DuckDB's SQL, over the table documents: crc32 by its table, near words by what is left when a code point is taken out or blanked.
VARIANTS_SQL = rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE len(run) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
  lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS h FROM runs, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word FROM hashed) WHERE len(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words),
gone AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS rest, left(word, i - 1) || '_' || substr(word, i + 1) AS blank FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.blank = b.blank AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
known AS (SELECT w.word, CASE WHEN b.m >= {TIMES} * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= {TIMES} * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, form AS root, 1 AS steps FROM known WHERE form IS NOT NULL UNION ALL SELECT c.word, k.form, c.steps + 1 FROM c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL) SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word)
SELECT k.word, k.form, coalesce(c.root, k.word) AS root, k.n, k.n_near, k.form_n FROM known k LEFT JOIN chain c USING (word)
"""
