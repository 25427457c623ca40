"""The pipeline's near-dedup and the toxicity index: what finds candidates, and what is held at once."""

import tracemalloc

import numpy as np

from cartulary.llm import simhash, toxicity
from cartulary.llm.toxicity import BlockMaxIndex, NEIGHBOURS, places_of


def test_simhash_finds_near_copies_without_prefixes(spark, monkeypatch):
    """With no candidates from prefixes, fingerprints of few differing bits alone bring up the near copies; texts that are no copies stay apart."""
    words = [f"w{k}" for k in range(800)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{k}" for k in range(800))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []
    monkeypatch.setattr(simhash, "links", lambda *a, f=simhash.links: met.append(a[1:]) or f(*a))
    for radius in (-1, simhash.RADIUS, None):  # no pair of prefixes is within -1 bits
        assert {r.doc_id: r.component_id for r in simhash.jaccard_components(rows, radius=radius).collect()} == {0: 0, 1: 0, 2: 2}
    assert met == [(1, 4, 7, 3)] * 3


def test_toxicity_index_holds_few_copies():
    rng = np.random.default_rng(3)
    size, each, terms = 4000, 500, 200_000
    row = np.repeat(np.arange(size, dtype=np.int32), each)
    t = np.sort(rng.permuted(np.tile(np.arange(0, terms, terms // each, dtype=np.int32), (size, 1)), axis=1) + rng.integers(0, terms // each, (size, each), dtype=np.int32), axis=1).ravel()
    want = BlockMaxIndex((row, t, np.ones(len(row), np.int32)), np.arange(size) % 2, np.ones(terms)).arrays()
    tracemalloc.start()
    held = [(row.copy(), t.copy(), np.ones(len(row), np.int32))]
    got = BlockMaxIndex(held.pop, np.arange(size) % 2, np.ones(terms)).arrays()
    assert tracemalloc.get_traced_memory()[1] < 43 * size * each  # bytes for each posting, its 12 included
    tracemalloc.stop()
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_toxicity_index_sums_few_examples():
    """Of examples in 40 subjects, the common terms are summed for few, and the nearest are those of all sums."""
    rng = np.random.default_rng(5)
    subjects = [rng.choice(2000, 100, replace=False) for _ in range(40)]
    counts = [[(int(t), int(rng.integers(1, 4))) for t in np.sort(rng.choice(subjects[k % 40], 60, replace=False))] for k in range(2000)]
    weight = rng.random(2000) + 0.5
    index = BlockMaxIndex(counts, [k % 2 for k in range(2000)], weight)
    assert index.k == NEIGHBOURS
    flat, read = index.weights, []

    class Seen(np.ndarray):
        def take(self, at, **how):
            read.append(len(at))
            return np.asarray(self).take(at, **how)

    index.column = index.column.view(Seen)
    for q in counts[:40]:
        t, w = index.vector(q)
        s = flat[:, t] @ w
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:NEIGHBOURS]
        rows, cosines = index.nearest(q)
        assert rows.tolist() == want.tolist()
        assert np.allclose(cosines, s[want], atol=1e-12, rtol=0)
    assert 0 < sum(read) < 0.1 * 40 * len(index.column)


def test_toxicity_index_without_axes_sums_all(monkeypatch):
    """Where the bounds tell nothing, all examples are summed from the postings, with the same result."""
    counts = [[(k % 7, 1), (7 + k % 11, 1), (18, 1)] for k in range(1500)]
    monkeypatch.setattr(toxicity, "_AXES", 0)
    index = BlockMaxIndex(counts, [k % 2 for k in range(1500)], np.ones(19))
    place = np.arange(1500)
    for k in range(20):
        t, w = index.vector(counts[k])
        s = np.where(place == k, -1, index.weights[:, t] @ w)
        want = np.lexsort((place, -np.round(s, 12)))[:NEIGHBOURS]
        rows, cosines = index.nearest(counts[k], k)
        assert rows.tolist() == want.tolist()
        assert np.allclose(cosines, s[want], atol=1e-12, rtol=0)


def test_hashes_are_looked_up_in_order():
    rng = np.random.default_rng(6)
    known = np.unique(rng.integers(-50, 50, 60))
    for size in (0, 1, 500):
        h = rng.integers(-60, 60, size)
        assert np.array_equal(places_of(h, known), np.searchsorted(known, h))
        assert np.array_equal(places_of(h, known[:0]), np.zeros(size, np.int64))
