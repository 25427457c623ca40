"""Toxicity by nearest labelled examples: exact TF-IDF cosine over an inverted index of all their terms, bounded by projections."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import bytes_of, crc_fold, resident, stretches, strings_of, tidy, trim, Workspace
from cartulary.llm.files import open_store, written_whole

#: Labelled rows that the classifier is fitted on, at most: those whose ids hash lowest.
EXAMPLES = 12_288
#: Chi-square at which a term of toxic texts has its whole weight: far beyond chance among the many
#: terms tried. Below, the weight falls with its square, to LEAST for terms that tell nothing.
CHI, LEAST = 30.0, 0.02
NEIGHBOURS = 15
#: A term in more than one of _OFTEN examples is common. Axes that the common terms of examples and texts are projected on, for bounds.
_OFTEN, _AXES = 32, 256
#: Postings lie in runs of _RUN, the last of a term's filled up. Examples, for each neighbour, whose sums give a text's bar, and beyond which all are summed at once.
_RUN, _FIRST, _MANY = 8, 2, 32
#: Bytes at which words are also cut, so that a stem counts in every word that starts with it.
_STEMS = (6, 7, 8)
#: Bytes of text whose terms are counted at once, texts searched at once (255 at most, and an index of under 2^24 examples, as they are sorted packed), and results that a task keeps.
_CHUNK, _AT_ONCE, _KEPT = 2 << 20, 128, 1 << 13

_FOLD = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_FOLDED = np.frombuffer(_FOLD, np.uint8)
_RANDOM = np.random.default_rng(20_240_307)
_TABLE, _ODD = _RANDOM.integers(0, 1 << 64, (64, 256), np.uint64), _RANDOM.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
_NONE = np.zeros(0, np.int64)


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits, A-Z lower-cased; bytes beyond ASCII count as letters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def terms_of(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"^" + word[:n] for n in _STEMS if len(word) >= n)]


def _summed(doc: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n summed by (doc, t), in that order."""
    if not len(doc):
        return doc, t, n
    span, bits = int(t.max()) + 1, int(n.max()).bit_length()
    key = doc * span + t
    if int(key.max()).bit_length() + bits < 63:
        packed = np.sort((key << bits) | n)
        key, n = packed >> bits, packed & ((1 << bits) - 1)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[starts]
    return key // span, key % span, np.add.reduceat(n, starts)


def term_hashes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of the terms of words, and each one's word.

    A hash sums random numbers drawn for (place, byte), beyond 64 places times an odd number for
    each turn; a stem's is the sum of its bytes, so all come from one running sum.
    """
    data, at = bytes_of(found)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    drawn = _TABLE[place & 63, data]
    if len(place) and place.max() > 63:
        drawn = drawn * (((place >> 6).astype(np.uint64) * _ODD[0]) | np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(drawn, dtype=np.uint64)])
    hashes, owners = [(total[at[1:]] - total[at[:-1]]) * _ODD[1]], [np.arange(len(found))]
    for n in _STEMS:
        own = np.flatnonzero(np.diff(at) >= n)
        hashes.append((total[at[own] + n] - total[at[own]]) * _ODD[1] + np.uint64(n))
        owners.append(own)
    hashes[0] = np.where(np.diff(at) > 0, hashes[0], np.uint64(0))
    return np.concatenate(hashes).view(np.int64), np.concatenate(owners)


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, n) of the texts' distinct words, in order, then the hashes of the words' terms and each one's word."""
    data, at = bytes_of(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(strings_of(_FOLDED[data], at))
    own = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return *_summed(doc, own.indices.to_numpy().astype(np.int64), np.ones(len(doc), np.int64)), *term_hashes(own.dictionary)


def places_of(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """np.searchsorted(known, h), with the hashes looked up in order: known is far larger than a processor's caches."""
    by = np.argsort(h)
    at = np.empty(len(h), np.int64)
    at[by] = np.searchsorted(known, h[by])
    return at


def counted(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, n) in order: the term's hash, or its number in the sorted hashes that are known, without others."""
    doc, word, n, h, owner = term_counts(texts)
    keep = h != 0
    if known is not None:
        at = np.minimum(places_of(h, known), max(0, len(known) - 1))
        keep &= known[at] == h if len(known) else False
    order = np.flatnonzero(keep)
    order = order[np.argsort(owner[order], kind="stable")]
    ends = np.searchsorted(owner[order], np.arange(int(word.max(initial=-1)) + 2))
    size = (ends[1:] - ends[:-1])[word]
    at_term = order[stretches(ends[:-1][word], size)]
    t = h if known is None else at
    if known is not None:
        return _summed(np.repeat(doc, size), t[at_term], np.repeat(n, size))
    distinct, number = np.unique(t[at_term], return_inverse=True)
    doc, number, n = _summed(np.repeat(doc, size), number, np.repeat(n, size))
    return doc, distinct[number], n


def counted_whole(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counted, of a text of more than _CHUNK bytes by pieces that end where a word does."""
    data, at = bytes_of(pc.fill_null(texts, ""))
    if len(data) <= 2 * _CHUNK:
        return counted(texts, known)
    out = []
    for k in range(len(at) - 1):
        own, lo = data[at[k] : at[k + 1]], 0
        while lo < len(own):
            hi = lo + _CHUNK
            while hi < len(own) and _FOLDED[own[hi]] != 32:
                hi += 1
            piece = pa.array([own[lo:hi].tobytes()], pa.binary()).cast(pa.large_string())
            doc, t, n = counted(piece, known)
            out.append((doc + k, t, n))
            lo = hi
    return _summed(*(np.concatenate([_NONE, *c]) for c in zip(*out)))


def gains(clean: np.ndarray, toxic: np.ndarray, n: int, p: int) -> np.ndarray:
    """What a term's idf is multiplied by, from the clean and toxic examples that have it, of n examples with p toxic ones."""
    a, b = clean.astype(np.float64), toxic.astype(np.float64)
    hit = a + b
    tells = (hit >= 3) & (hit < n) & (b * (n - p) > a * p)
    chi = n * (b * (n - p) - a * p) ** 2 / np.maximum(hit * (n - hit) * max(p, 1) * max(n - p, 1), 1)
    return LEAST + (1 - LEAST) * np.where(tells, np.minimum(1, chi / CHI) ** 2, 0)


def _projected(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal axes near those of the greatest spread, and each row's part along each of them, then the length of what is left."""
    axes = np.random.default_rng(7).standard_normal((rows.shape[1], min(_AXES, *rows.shape)))
    for _ in range(4):
        axes = np.linalg.qr(axes)[0]
        axes = (rows.T @ (rows @ axes.astype(np.float32))).astype(np.float64)
    axes = np.linalg.qr(axes)[0]
    drawn = np.empty((len(rows), axes.shape[1] + 1), np.float32)
    for k in range(0, len(rows), 512):
        own = rows[k : k + 512].astype(np.float64)
        part = own @ axes
        drawn[k : k + 512] = np.column_stack([part, np.sqrt(np.maximum((own * own).sum(1) - (part * part).sum(1), 0))])
    return axes, drawn


class BlockMaxIndex:
    """Examples by term.

    Postings of rare terms are summed for all examples. What the common terms can add is bounded:
    texts and examples are projected on a few axes, and beside their parts along these nothing
    exceeds the product of the lengths that are left (Cauchy-Schwarz). The examples that promise
    most are summed, and then every one whose bound reaches the k-th best of these; the others are
    no better. Sums are rounded to single precision to be sorted, so all within its error of the
    k-th best are summed again in double: the result is the exact top k (ties: the lower example
    first).
    """

    ARRAYS = ("labels", "idf", "at", "row", "w", "place", "axes", "drawn", "ends", "column", "weight")

    def __init__(self, counts, labels, weight: np.ndarray, k: int = NEIGHBOURS, line: tuple[float, float] = (1.0, 0.0)):
        """counts: of each example its (term, n) pairs, or all at once as arrays (example, term, n), or a function that gives these and keeps none, so that each goes as soon as it is used."""
        if isinstance(counts, list):
            flat = [(row, *c) for row, of in enumerate(counts) for c in of]
            counts = tuple(np.array(flat, np.int64).reshape(-1, 3).T)
        row, t, n = counts() if callable(counts) else counts
        del counts
        size, terms = len(labels), len(weight)
        empty = np.bincount(row, minlength=size) == 0
        w = np.log(n)
        del n
        w += 1
        for at in range(0, len(w), 1 << 20):
            w[at : at + (1 << 20)] *= weight[t[at : at + (1 << 20)]]
        w /= np.sqrt(np.bincount(row, w * w, size))[row]
        df = np.bincount(t, minlength=terms)
        often = np.flatnonzero(df * _OFTEN > size)
        place = np.full(terms, -1, np.int32)
        place[often] = np.arange(len(often))
        thick = place[t] >= 0
        # the common terms' weights by example, all terms' postings by term
        own, column = row[thick], place[t[thick]]
        by = np.lexsort((column, own))
        common = {"ends": np.searchsorted(own[by], np.arange(size + 1)), "column": column[by], "weight": w[thick][by]}
        del own, column, by, thick
        dense = np.zeros((size, len(often)), np.float32)
        dense[np.repeat(np.arange(size), np.diff(common["ends"])), common["column"]] = common["weight"]
        axes, drawn = _projected(dense)
        del dense
        by = np.argsort(t, kind="stable")
        del t
        row = row[by].astype(np.int16 if size < 1 << 15 else np.int32)
        w = w[by]
        del by
        starts = np.concatenate([[0], np.cumsum(-(-df // _RUN))])
        to = stretches(starts[:-1] * _RUN, df)
        rows = np.full((starts[-1], _RUN), size, row.dtype)
        rows.ravel()[to] = row
        del row
        values = np.zeros((starts[-1], _RUN))
        values.ravel()[to] = w
        del to, w
        self._set(line, k, labels=np.asarray(labels, np.float64), idf=weight, at=starts, row=rows, w=values, place=place, axes=axes, drawn=drawn, **common)
        # A text without a term has no neighbours: the rate among such examples stands for it.
        self.none = (self.labels[empty].sum() + self.rate) / (empty.sum() + 1)

    def _set(self, line, k: int, **arrays: np.ndarray) -> None:
        self.slope, self.shift = line
        self.k = k
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        self.rate = (self.labels.sum() + 0.5) / (len(self.labels) + 1)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], k: int = NEIGHBOURS) -> BlockMaxIndex:
        out = cls.__new__(cls)
        out._set((1.0, 0.0), k, **arrays)
        out.none = float(arrays["none"][0])
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in self.ARRAYS} | {"none": np.array([self.none])}

    @property
    def weights(self) -> np.ndarray:
        """All weights, an example a row."""
        size = len(self.labels)
        out = np.zeros((size, len(self.idf)))
        real = self.row < size
        out[self.row[real], np.repeat(np.arange(len(self.idf)), np.diff(self.at) * _RUN)[real.ravel()]] = self.w[real]
        return out

    def unit(self, doc: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weights of texts' terms, each text's of length 1."""
        w = (1 + np.log(n)) * self.idf[t]
        return w / np.sqrt(np.bincount(doc, w * w))[doc] if len(w) else w

    def search(self, doc: np.ndarray, t: np.ndarray, w: np.ndarray, m: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k examples of the highest cosine above zero of each of m texts, best first. skip: an example that a text passes over."""
        size, dims = len(self.labels), len(self.axes)
        if not size or not m:
            return _NONE, _NONE, np.zeros(0)
        error = np.float32((dims + 16) * 2.0**-23)
        place = self.place[t]
        thick = place >= 0
        query = np.zeros((m, dims))
        query[doc[thick], place[thick]] = w[thick]

        def sums(doc: np.ndarray, t: np.ndarray, w: np.ndarray) -> Iterator[np.ndarray]:
            """What terms add to the cosines of all examples, text by text."""
            ends, lo = np.searchsorted(doc, np.arange(m + 1)), self.at[t]
            n = self.at[t + 1] - lo
            for q in range(m):
                own = slice(ends[q], ends[q + 1])
                at = stretches(lo[own], n[own])
                # a run is copied at once; take checks no bounds in this mode
                each = self.w.take(at, axis=0, mode="clip")
                each *= np.repeat(w[own], n[own])[:, None]
                yield np.bincount(self.row.take(at, axis=0, mode="clip").ravel(), each.ravel(), size + 1)[:size]

        def common(q: int, at: np.ndarray) -> np.ndarray:
            """What the common terms of a text add to its cosines with some examples."""
            sizes = self.ends[at + 1] - self.ends[at]
            own = stretches(self.ends[at], sizes)
            each = query[q].take(self.column.take(own, mode="clip"), mode="clip")
            each *= self.weight.take(own, mode="clip")
            return np.bincount(np.repeat(np.arange(len(at)), sizes), each, len(at))

        rare = np.empty((m, size))
        for q, added in enumerate(sums(doc[~thick], t[~thick], w[~thick])):
            rare[q] = added
        if skip is not None:
            rare[np.arange(m), skip] = -9.0
        part = query @ self.axes
        beside = np.sqrt(np.maximum(np.einsum("ij,ij->i", query, query) - np.einsum("ij,ij->i", part, part), 0))
        bound = np.column_stack([part, beside]).astype(np.float32) @ self.drawn.T
        bound += rare
        bound += error
        # the k-th best of any sums is a bar that the k-th best of all reaches
        some = min(_FIRST * self.k, size)
        high = np.partition(bound, size - some, axis=1)[:, size - some]
        low = np.full(m, -2 * error)
        found = []
        for q in range(m):
            at = np.flatnonzero(bound[q] >= high[q])[:some]
            kept = rare[q, at] + common(q, at)
            if size >= self.k:
                low[q] += np.maximum(np.partition(kept, -self.k)[-self.k], 0)
            bound[q, at] = -9
            more = np.flatnonzero(bound[q] >= low[q])
            if len(more) > _MANY * self.k:
                own = slice(*np.searchsorted(doc, [q, q + 1]))
                own = np.flatnonzero(thick[own]) + own.start
                more_kept = rare[q, more] + next(sums(doc[own] - q, t[own], w[own]))[more]
            else:
                more_kept = rare[q, more] + common(q, more)
            at, kept = np.concatenate([at, more]), np.concatenate([kept, more_kept]).astype(np.float32)
            live = kept >= low[q]
            found.append((at[live], kept[live]))
        text = np.repeat(np.arange(m), [len(at) for at, _ in found])
        at, kept = (np.concatenate(c) for c in zip(*found))
        # of each text, those within the error of its k-th best; a cosine's bits, as those above zero, sort like it
        bits = np.maximum(kept, np.float32(0)).view(np.int32).astype(np.int64)
        packed = np.sort((((text << 31) | (0x7FFFFFFF - bits)) << 24) | at)
        text, at, value = packed >> 55, packed & 0xFFFFFF, (0x7FFFFFFF - ((packed >> 24) & 0x7FFFFFFF)).astype(np.int32).view(np.float32)
        starts = np.searchsorted(text, np.arange(m + 1))
        last = value[np.minimum(starts[:-1] + self.k, np.maximum(starts[1:], 1)) - 1] if len(value) else np.zeros(m, np.float32)
        close = value >= last[text] - 2 * error
        text, at = text[close], at[close]
        cosine = rare[text, at]
        sizes = self.ends[at + 1] - self.ends[at]
        own = stretches(self.ends[at], sizes)
        pair = np.repeat(np.arange(len(at)), sizes)
        cosine += np.bincount(pair, query[text[pair], self.column[own]] * self.weight[own], len(at))
        by = np.lexsort((at, -np.round(cosine, 12), text))
        by = by[cosine[by] > 0]
        text, example, cosine = text[by], at[by], np.minimum(cosine[by], 1.0)
        keep = np.arange(len(text)) - np.searchsorted(text, text) < self.k
        return text[keep], example[keep], cosine[keep]

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        t, n = np.array(counts, np.int64).reshape(-1, 2).T
        return t, self.unit(np.zeros(len(t), np.int64), t, n)

    def nearest(self, counts, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k examples nearest to one text."""
        t, w = self.vector(counts)
        _, rows, cosines = self.search(np.zeros(len(t), np.int64), t, w, 1, None if skip < 0 else np.array([skip]))
        return rows, cosines

    def votes(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, m: int) -> np.ndarray:
        """Votes weigh 1 / (distance + 0.1); one vote of weight 1 holds the overall rate."""
        w = 1 / (1.1 - cosine)
        return (np.bincount(text, w * self.labels[example], m) + self.rate) / (np.bincount(text, w, m) + 1)

    def scores(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, m: int) -> np.ndarray:
        v = self.votes(text, example, cosine, m)
        p = 1 / (1 + np.exp(-np.clip(self.slope * np.log(v / (1 - v)) + self.shift, -30, 30)))
        return np.where(np.bincount(text, minlength=m) > 0, p, self.none)


def calibrate(votes: list[tuple[float, int]]) -> tuple[float, float]:
    """Platt's line over the log odds of leave-one-out votes, by Newton steps with a weak prior at the identity."""
    if len({y for _, y in votes}) < 2:
        return 1.0, 0.0
    v, y = np.array(sorted(votes)).T
    x = np.column_stack([np.log(v / (1 - v)), np.ones(len(v))])
    start = beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (y - p) - (beta - start))
        beta = beta + np.clip(step, -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file of the shared folder: a line that lists them, then their bytes at multiples of 64."""
    listed, at = {}, 0
    for k, a in arrays.items():
        listed[k] = (a.dtype.str, list(a.shape), at)
        at += a.nbytes + -a.nbytes % 64
    head = json.dumps(listed).encode()
    store, root = open_store(folder)
    with written_whole(store, f"{root}/{name}") as out:
        out.write(len(head).to_bytes(64, "little") + head + b" " * (-len(head) % 64))
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")
            out.write(b"\0" * (-a.nbytes % 64))


def load_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """What save_arrays wrote; of a local file the pages that are used, shared by the workers of a machine."""
    store, root = open_store(folder)
    if isinstance(store, fs.LocalFileSystem):
        data = pa.memory_map(f"{root}/{name}").read_buffer()
    else:
        with store.open_input_file(f"{root}/{name}") as f:
            data = f.read_buffer()
    head = int.from_bytes(memoryview(data)[:64], "little")
    base = 64 + head + -head % 64
    listed = json.loads(bytes(memoryview(data)[64 : 64 + head]))
    return {k: np.frombuffer(data, kind, math.prod(shape), base + at).reshape(shape) if math.prod(shape) else np.zeros(shape, kind) for k, (kind, shape, at) in listed.items()}


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    *,
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.3,
    examples: int = EXAMPLES,
    carry: list[str] = (),
) -> DataFrame:
    """One row for each input row: id, held_out, score, predicted, and the evidence: ids and cosines of the nearest examples; then the columns to carry, of which those named like the former give way.

    Labels are read only of rows whose crc32(id as text) mod folds is not held_out. The classifier
    is a bounded sample: the `examples` labelled rows whose ids hash lowest (equal texts are one
    example), with all their terms (words and word starts), each weighted by idf and by how far
    chi-square in them tells toxic texts. Document frequencies count all documents. The index is
    bounded by the examples; one task writes it to the shared folder, where all tasks read it, and
    no text is shuffled but the examples'.

    A null or empty text, and one without any of the terms, scores the rate of such examples,
    smoothed to the overall rate. Null ids are never held out and never examples; an id labelled
    more than once counts its highest label, as does an example's text, and of repeated rows of an
    example's id the least text is taken. Null labels are none. Without labels all scores are 0.5.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(crc_fold(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    known = known.join(rows.select("id").where("id is not null").distinct(), "id", "left_semi")
    chosen = work.stage(known.orderBy(F.xxhash64("id"), "id").limit(examples), "chosen")
    texts = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    this = work.root

    def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
        """Rows of about _CHUNK bytes of text, and 4,096 at most."""
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(size, (size[at - 1] if at else 0) + _CHUNK)) + 1
                stop = min(max(stop, at + 1), at + 4096, batch.num_rows)
                yield batch.slice(at, stop - at)
                at = stop

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident(f"toxicity {this}", "began", lambda: True)  # what an operator before kept in the worker goes
        for batch in chunks(batches, 2):
            texts = batch.column(2)
            doc, h, n = counted(texts)
            ends = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)), pa.int32())
            digests = pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], digests, *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h, n.astype(np.int32)))], ["id", "label", "digest", "h", "n"])

    terms = work.stage(texts.mapInArrow(tidy(listed), f"id {kind}, label int, digest binary, h array<long>, n array<int>"), "terms")
    listed_at = terms._staged_at

    hashes = work.stage(terms.select(F.explode("h").alias("h")).distinct(), "hashes")
    hashes_at = hashes._staged_at

    def table_of(root: str, columns: list[str] | None = None) -> pa.Table:
        store, path = open_store(root)
        return ds.dataset(path, filesystem=store, format="parquet").to_table(columns)

    def in_one_task(make: Callable[[], dict[str, np.ndarray]], name: str) -> None:
        """Has one task write arrays that are bounded by the examples."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    save_arrays(this, name, make())
                    trim()
                yield batch

        spark.range(0, 1, 1, 1).mapInArrow(tidy(run), "id long").collect()

    def distinct_of(found: pa.Table) -> tuple[list[int], list[int]]:
        """The rows of the distinct texts, in the order of their ids, and their labels."""
        names, digests = found.column("id").to_pylist(), found.column("digest").to_pylist()
        first: dict[bytes, int] = {}
        for r in sorted(range(len(found)), key=[str(x) for x in names].__getitem__):
            first.setdefault(digests[r], r)
        label = dict.fromkeys(first, 0)
        for d, y in zip(digests, found.column("label").to_pylist()):
            label[d] = max(label[d], int(y > 0))
        return list(first.values()), list(label.values())

    def examples_of() -> dict[str, np.ndarray]:
        """Ids and labels of the distinct texts, in the order of their ids, and the sorted hashes of all terms."""
        found = table_of(listed_at, ["id", "label", "digest"])
        rows, label = distinct_of(found)
        ids = pa.RecordBatch.from_arrays([found.column("id").take(pa.array(rows, pa.int64())).combine_chunks()], ["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as out:
            out.write_batch(ids)
        return {"ids": np.frombuffer(sink.getvalue(), np.uint8), "labels": np.array(label, np.int64), "known": np.sort(table_of(hashes_at).column("h").to_numpy())}

    def postings_of() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(example, term, n) of all examples, in their order. The lists are read part by part, so that no more than a part of the hashes is held."""
        store, path = open_store(listed_at)
        table = ds.dataset(path, filesystem=store, format="parquet")
        found = table.to_table({"id": ds.field("id"), "label": ds.field("label"), "digest": ds.field("digest"), "size": pc.list_value_length(ds.field("h"))})
        rows, _ = distinct_of(found)
        size = found.column("size").to_numpy()
        at = np.full(len(size), -1, np.int64)
        at[rows] = np.cumsum(size[rows]) - size[rows]
        row = np.repeat(np.arange(len(rows), dtype=np.int32), size[rows])
        t, n, r, known = np.empty(len(row), np.int32), np.empty(len(row), np.int32), 0, sample()["known"]
        del found
        for batch in table.to_batches(columns=["h", "n"], batch_size=256, batch_readahead=1, fragment_readahead=1, use_threads=False):
            own, k = np.searchsorted(known, batch.column(0).flatten().to_numpy()).astype(np.int32), 0
            many = batch.column(1).flatten().to_numpy()
            for r in range(r, r + batch.num_rows):
                if at[r] >= 0:
                    t[at[r] : at[r] + size[r]], n[at[r] : at[r] + size[r]] = own[k : k + size[r]], many[k : k + size[r]]
                k += size[r]
            r += batch.num_rows > 0
        trim()
        return row, t, n

    in_one_task(examples_of, "examples")

    def sample() -> dict[str, np.ndarray]:
        return resident(f"toxicity {this}", "examples", lambda: load_arrays(this, "examples"))

    def ids_of() -> list:
        return resident(f"toxicity {this}", "ids", lambda: pa.ipc.open_stream(pa.py_buffer(sample()["ids"].tobytes())).read_all().column(0).to_pylist())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sample()["known"]
        df = np.zeros(len(known), np.int64)
        for batch in chunks(batches, 0):
            df += np.bincount(counted_whole(batch.column(0), known)[1], minlength=len(df))
        some = np.flatnonzero(df)
        for k in range(0, len(some), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 200_000]), pa.array(df[some[k : k + 200_000]])], ["t", "df"])

    df = work.stage(rows.select("text").mapInArrow(tidy(frequencies), "t long, df long").groupBy("t").agg(F.sum("df").alias("df")), "frequencies")
    total, df_at = rows.count(), df._staged_at

    def index_of() -> dict[str, np.ndarray]:
        labels, known, held = sample()["labels"], sample()["known"], [postings_of()]
        df, found = np.zeros(len(known)), table_of(df_at)
        if len(found):
            df[found.column("t").to_numpy()] = found.column("df").to_numpy()
        row, t, _ = held[0]
        toxic = np.bincount(t[labels[row] > 0], minlength=len(df)).astype(np.float64)
        gain = gains(np.bincount(t, minlength=len(df)) - toxic, toxic, len(labels), int(labels.sum()))
        del found, row, t
        return BlockMaxIndex(held.pop, labels, (np.log((1 + total) / (1 + df)) + 1) * gain).arrays()

    in_one_task(index_of, "index")

    def index(line: tuple[float, float] = (1.0, 0.0)) -> BlockMaxIndex:
        out = resident(f"toxicity {this}", "index", lambda: BlockMaxIndex.of(load_arrays(this, "index")))
        out.slope, out.shift = line
        return out

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, labels = index(), {x: k for k, x in enumerate(ids_of())}, sample()["labels"]
        for batch in (b.slice(k, _AT_ONCE) for b in batches for k in range(0, b.num_rows, _AT_ONCE)):
            mine = [(at[x], h, n) for x, h, n in zip(*(batch.column(k).to_pylist() for k in range(3))) if x in at and h]
            doc = np.repeat(np.arange(len(mine)), [len(h) for _, h, _ in mine])
            t = np.searchsorted(sample()["known"], np.array([x for _, h, _ in mine for x in h], np.int64))
            w = own.unit(doc, t, np.array([x for _, _, n in mine for x in n], np.int64))
            skip = np.array([k for k, _, _ in mine], np.int64)
            v = own.votes(*own.search(doc, t, w, len(mine), skip), len(mine)) if mine else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64()), pa.array(labels[skip].astype(np.int32))], ["vote", "label"])

    line = calibrate([tuple(r) for r in terms.select("id", "h", "n").mapInArrow(tidy(votes), "vote double, label int").collect()])
    for used in (chosen, terms, hashes, df):
        work.drop(used)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, own, done = ids_of(), sample()["known"], index(line), {}
        for batch in chunks(batches, 1):
            doc, t, n = counted_whole(batch.column(1), known)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            keys = [xxhash.xxh3_128_digest(t[a:b].tobytes() + n[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            if len(done) >= _KEPT:
                done.clear()
            new = {key: k for k, key in enumerate(keys) if key not in done}
            todo = sorted(new.values())
            for k in range(0, len(todo), _AT_ONCE):
                part = todo[k : k + _AT_ONCE]
                size = ends[np.array(part) + 1] - ends[part]
                at, which = stretches(ends[part], size), np.repeat(np.arange(len(part)), size)
                found = own.search(which, t[at], own.unit(which, t[at], n[at]), len(part))
                scores, first = own.scores(*found, len(part)), np.searchsorted(found[0], np.arange(len(part) + 1))
                for j, q in enumerate(part):
                    a, b = first[j], min(first[j] + 3, first[j + 1])
                    done[keys[q]] = (float(scores[j]), [names[r] for r in found[1][a:b]], found[2][a:b].tolist())
            out = list(zip(*(done[key] for key in keys)))
            found = [pa.array(out[0], pa.float64()), pa.array(out[1], pa.list_(batch.column(0).type)), pa.array(out[2], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *(batch.column(k) for k in places)], ["id", "score", "nearest", "cosines", *kinds])

    carry = [c for c in carry if c not in (id_col, "held_out", "score", "predicted", "nearest", "cosines")]
    others = [c for c in carry if c != text_col]
    places = [1 if c == text_col else 2 + others.index(c) for c in carry]
    kinds = {f"_{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(carry)}
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(others)])
    scored = whole.mapInArrow(tidy(score), f"id {kind}, score double, nearest array<{kind}>, cosines array<double>" + "".join(f", {n} {t}" for n, t in kinds.items()))
    fold = F.coalesce(crc_fold(F.col("id"), folds) == held_out, F.lit(False))
    own = [F.col("id").alias(id_col), fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "nearest", "cosines"]
    return scored.select(*own, *[F.col(n).alias(c) for n, c in zip(kinds, carry)])
