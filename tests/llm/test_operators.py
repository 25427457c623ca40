"""Operators against brute force, exact round trips and edge cases, on small fixtures."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartulary.llm import media, ppm, simhash, tokens
from cartulary.llm.bpe import BacktrackingBPE, bpe_round_trip
from cartulary.llm.common import components, Workspace, words_of
from cartulary.llm.language import identify_languages
from cartulary.llm.mixing import mix
from cartulary.llm.pivots import pivot_links, unit
from cartulary.llm.secrets import redact_secrets, scan_secrets
from cartulary.llm.toxicity import BlockMaxIndex, score_toxicity
from corpus_pipeline import keep_distinct, mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, id string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, white space, a very long text, copies, repeated rows and extra columns with clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [base, base, base.replace("twelve", "dozen"), None, "", " \n\t ", "a", "long words here " * 20_000, "The idiot said token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" ok", "né à l'école <|endoftext|> fin"]
    rows = [(k, t, "en", None if k % 4 == 3 else f"src{k % 3}", len(t or ""), "x", "y") for k, t in enumerate(texts)]
    rows += [rows[0], (None, "alone", None, None, 5, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()

    def bits(text):
        w = words_of(text)
        s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    prints = [bits(r.text[:4000] if r.text and len(r.text) > 9999 else r.text) for r in rows]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(docs).collect()}
    assert len(simhash.simhash_components(docs).collect()) == len(rows)
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= 4:
                    root[i] = min(root[i], root[j])
    for i, r in enumerate(rows):
        if r.text is None or len(r.text) < 9999:
            ids = [rows[j].doc_id for j in range(len(rows)) if root[j] == root[i] and rows[j].doc_id is not None]
            assert got[r.doc_id, f"{prints[i]:016x}"] == (min(ids) if ids else None)


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    word = np.array([f"w{k}" for k in range(4000)])
    boiler = " ".join(rng.choice(word, 60))
    texts = ["", None, " ", "one two", "ONE two", "a b c d e f g h", "a b c d e f g h i", boiler]
    for _ in range(60):
        base = rng.choice(word, rng.integers(30, 300))
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.022, 0.025, 0.03):
            other = base.copy()
            at = rng.random(len(base)) < share
            other[at] = rng.choice(word, at.sum())
            texts.append(" ".join(other))
        texts.append(f"{boiler} {' '.join(base[:40])}")
    texts += [" ".join([*word[:400], f"copy{k}"]) for k in range(600)]
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set()))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    rows = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in [*enumerate(texts), (0, texts[0])]], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in keep_distinct(spark, rows, "").collect()} == {i for i in range(len(texts)) if top(i) == i}
    for radius in (simhash.RADIUS, None):
        got = simhash.jaccard_components(rows, radius=radius).collect()
        assert len(got) == len(texts) + 1
        assert {r.doc_id: r.component_id for r in got} == {i: top(i) for i in range(len(texts))}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(31))
    assert all(got[k] == 100 for k in range(100, 140))


def test_mix_takes_targets(spark, docs):
    rows = mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs).collect()), key=str)
    assert sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows) + len(rows)


def test_mix_meets_targets_beyond_a_million_words(spark):
    rows = [(k, "w " * 20_000, "big") for k in range(150)] + [(1000 + k, "w " * (1 + k % 3), f"tiny{k % 7}") for k in range(60)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    of = {k: s for k, _, s in rows}
    for name in set(of.values()):
        mine = [r for r in found if of[r["doc_id"]] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in mine)


def test_pipeline_mix_keeps_texts_whole(spark):
    rows = [(k, " ".join(f"d{k}w{j}" for j in range(5 + k % 40)), "en", f"s{k % 3}", 0) for k in range(900)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    text, out = {r[0]: r[1] for r in rows}, mix_sources(spark, table, "").collect()
    assert all(r.text == text[r.doc_id] and r.n_chars == len(r.text) for r in out)
    assert max(Counter(r.doc_id for r in out).values()) <= 3
    want = {r["doc_id"]: r["target"] for r in mix(table).collect()}
    for k in range(3):
        assert abs(sum(len(r.text.split()) for r in out if r.source == f"s{k}") - want[k]) <= 10


BPE = BacktrackingBPE(open(BYTE_BPE, "rb").read())
LIBRARY = Tokenizer.from_file(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("aeht in'\n.<|endoftext|>é", max_size=120))
def test_bpe_equals_the_library(text):
    ids = BPE.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_bpe_table(docs):
    for r in bpe_round_trip(docs.select("doc_id", "text", "extra"), BYTE_BPE, carry=["text"]).collect():
        assert r.decoded == (r.text or "") and 4 * r.n_tokens == len(r.ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300) | st.just(0), max_size=400))
def test_simple8b_round_trip(ids):
    assert tokens.unpack(tokens.pack(np.array(ids, np.uint32))).tolist() == ids


def test_token_files(docs):
    got = {(r.doc_id, r.start): r for r in tokens.tokens_round_trip(docs, WORD_BPE).collect()}
    library, at = Tokenizer.from_file(WORD_BPE), 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert bytes(got[r.doc_id, at].ids) == ids.tobytes()
        at += len(ids)
    assert len(got) == len(rows)


def test_media(docs):
    rows = media.media_columns(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == docs.count()
    for r in rows:
        raw = text[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.width * r.height == len(payload)


def test_ppm_is_a_distribution_and_base_is_exact(spark, docs, monkeypatch):
    texts = [b"abracadabra", b"abra", b"cad abra abra"]
    code = np.sort(ppm.gram_codes(texts)[0])
    code, n = np.unique(code, return_counts=True)
    low, where = np.unique(code & np.uint64(0xFFFF), return_inverse=True)
    trie = ppm.Trie(code, n, (low, np.bincount(where, n).astype(np.int64)))
    for context in (b"abrac", b"zzzzz", b"zzabr", b"\0\0\0\0\0"):
        every = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-9
    whole = ppm.score_texts(docs).collect()
    assert len(whole) == docs.count()
    rows = docs.select("doc_id", "text").collect()
    train = [r for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = {}
    for r in train:
        for w in [*words_of(r.text), None]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in rows:
        want = sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in [*words_of(r.text), None])
        assert any(g.doc_id == r.doc_id and abs(g.base_score - want) < 1e-6 * max(1, abs(want)) and g.train_tokens == total for g in whole)
    monkeypatch.setattr(ppm, "SLICE", 50)
    sliced = sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6)) for r in ppm.score_texts(docs).collect())
    assert sliced == sorted((str(r.doc_id), round(r.score, 6), round(r.base_score, 6)) for r in whole)


def test_ppm_words_beside_a_long_word(spark):
    long = "https://example.org/" + "x" * 80
    texts = ["the cat", f"the {long} cat", "the dog", f"{long} the", "a dog", long[:-1] + "y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6, "doc_id")
    counts = {}
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            for w in [*words_of(t), None]:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in ppm.score_texts(table).collect():
        found = [counts.get(w, 0) for w in [*words_of(texts[r.doc_id]), None]]
        assert r.n_known == sum(c > 0 for c in found)
        assert abs(r.base_score - sum(np.log10((c + 1) / (total + len(counts) + 1)) for c in found)) < 1e-9


def test_pivots_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    near = base[:60] + 0.04 * rng.standard_normal((60, 32)) * 1.5
    crowd = base[0] + 0.01 * rng.standard_normal((700, 32))
    v = np.vstack([base, near, crowd, base[:3]])
    odd = [None, [0.0] * 32, [float("nan")] * 32, [], [None] * 32, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, x if x is None else [None if y is None else float(y) for y in x]) for k, x in enumerate([*v.tolist(), *odd])]
    got = {r.vec_id: r for r in pivot_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = unit(v.astype(np.float32))
    links = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[k].n_links for k in range(len(v))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    n = len(v)
    assert [(got[n + k].n_links, got[n + k].component_id, got[n + k].kept) for k in range(5)] == [(0, n + k, True) for k in range(5)]
    assert got[n + 6].component_id == n + 5


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    counts = [tuple((int(t), int(rng.integers(1, 4))) for t in sorted(rng.choice(30, rng.integers(1, 6), replace=False))) for _ in range(500)]
    index = BlockMaxIndex(counts, [k % 2 for k in range(500)], rng.random(30) + 0.5)
    flat = index.weights.reshape(-1, 30).astype(np.float64)
    for q in counts[:40]:
        t, w = index.vector(q)
        s = flat[:, t] @ w
        want = np.lexsort((np.arange(len(s)), -s))[: index.k]
        rows, scores = index.nearest(q)
        assert np.allclose(scores, s[want][: len(scores)])


def test_toxicity_learns(spark, docs):
    words = ["calm", "tree", "river", "stone", "cloud"]
    rows = [(k, " ".join(words[(k * j) % 5] for j in range(1, 9)) + f" w{k}" + (" you idiot" if k % 5 == 0 else ""), k % 5 == 0) for k in range(400)]
    table = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (None, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(table, labels).collect()}
    held = [k for k, _, _ in rows if got[k].held_out]
    assert held and all(got[k].predicted == int(k % 5 == 0) for k in held)
    assert got[900].predicted == got[901].predicted == 0 and got[None].predicted == 1


def test_toxicity_compares_whole_texts_of_a_small_table(spark):
    words = [f"word{k}" for k in range(60)]
    rows = [(k, " ".join(words[(7 * k + j * j) % 60] for j in range(12)) + (f" oaf{k} you" if k % 7 == 0 else "")) for k in range(60)]
    table = spark.createDataFrame(rows + [(1000 + k, t) for k, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in score_toxicity(table, spark.createDataFrame([(k, int(k % 7 == 0)) for k, _ in rows], "doc_id long, toxic int")).collect()}
    text = dict(rows)
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            assert text[got[1000 + k].nearest[0]] == t and abs(got[1000 + k].cosines[0] - 1) < 1e-9
    assert len({round(r.score, 9) for r in got.values()}) > 2


def test_secrets(spark, docs):
    found = scan_secrets(docs).collect()
    assert [(r.doc_id, r.value, r.secret) for r in found] == [(8, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", True)]
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert text[8][found[0].start : found[0].start + found[0].length] == found[0].value
    masked = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert masked[8] == text[8].replace(found[0].value, "[secret]")
    assert all(masked[k] == text[k] for k in text if k != 8)


def test_language(spark):
    de, fr = "der die das und ist nicht ein", "le la les des est pas une"
    labelled = spark.createDataFrame([(k, de if k % 2 else fr, "de" if k % 2 else "fr") for k in range(20)] + [(99, None, None)], "doc_id long, text string, lang string")
    pages = [(1, "https://a.de/x", f"<html lang='de-AT'><p>{de}</p>"), (2, "https://b.fr/", f"<html><script>{de}</script><p>{fr}</p>"), (3, None, None), (4, "https://a.de/y", ""), (5, "not an address", "<p>und</p>"), (None, "https://a.de/z", de)]
    pages += [(10 + k, "https://a.de/" + str(k), f"<p>{de}</p>") for k in range(10)]
    got = {r.page_id: r for r in identify_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), labelled).collect()}
    assert got[1].lang == "de" and got[2].lang == "fr" and got[4].lang == "de" and got[None].lang == "de" and len(got) == 16
    assert got[1].declared == "de" and got[3].host is None


def test_empty_tables(spark, none):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        simhash.simhash_components(none), mix(none), bpe_round_trip(none, BYTE_BPE), tokens.tokens_round_trip(none, WORD_BPE), media.media_columns(none), ppm.score_texts(none), pivot_links(empty),
        score_toxicity(none, labels), scan_secrets(none), identify_languages(pages, none),
    ):
        assert df.count() == 0
