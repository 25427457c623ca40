"""Source divergence, spelling variants and quality: against plain versions, DuckDB, held-out labels and edge cases."""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartulary.llm import divergence, quality, variants
from cartulary.llm.common import pieces, tiled, Workspace
from cartulary.llm.divergence import audit_sources
from cartulary.llm.quality import score_quality
from cartulary.llm.queries import ORACLES, QUERIES
from cartulary.llm.variants import group_variants

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, word string, term string, id string, n long"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "i", 9) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_variants"])
def test_equals_duckdb(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r[x] for x in want.columns) for r in df.collect()) == Counter(want.fetchall())


def test_pieces_cut_at_spaces():
    text = b"ab  cde f" * 50 + b"x" * 300 + b" y"
    for size in (1, 7, 100, 10_000):
        got = list(pieces(text, size))
        assert b"".join(got) == text and [w for p in got for w in p.split()] == text.split()
    assert list(pieces(b"")) == []


# --- source divergence ----------------------------------------------------------------------------


def plain_audit(rows, least=divergence.LEAST, top=divergence.TOP):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(n):
            total = sum(n[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 1) // total for t in kept}

        all_of = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        far = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(far(p[s][t], all_of[t]), t) for t in kept if count[lang, s][t] and p[s][t] > all_of[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return Counter(out)


def audited(df, **more):
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in audit_sources(df, **more).collect())


@pytest.fixture(scope="module")
def notes(spark):
    rng = np.random.default_rng(11)
    word = np.array(["The", "the", "and", "né", "école", "ÉCOLE", "don't", "x_y", "日本", "a1b", *(f"w{chr(97 + k)}q" for k in range(26))])
    rows = []
    for k in range(120):
        source = "hot" if k % 3 == 0 else f"s{k % 5}"
        rows.append((k, " ".join(rng.choice(word[: 8 + 5 * (k % 6)], rng.integers(0, 60))), ["en", "de", None][k % 7 // 3], None if k % 11 == 0 else source))
    rows += [(200, None, "en", "s1"), (201, "", "xx", "only"), (202, " 12 \t", "xx", "other"), (None, "the the and", None, None), (203, "the and " * 60_000 + "tail", "en", "long"), rows[5], rows[5], (204, "solo solo", "yy", "s1")]
    return rows


def test_divergence_equals_plain_version(spark, notes):
    assert audited(table(spark, notes)) == plain_audit(notes)
    assert audited(table(spark, notes), least=1, top=2) == plain_audit(notes, 1, 2)
    assert audited(table(spark, notes[:0])) == Counter()
    assert audit_sources(table(spark, notes[:0])).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_sends_stretches(spark, notes, monkeypatch):
    """Small stretches, and a scan whose terms run over batches, change nothing."""
    columns = [[(r[k] or "").encode() for r in notes[:40]] for k in (1, 2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["text", "lang", "source"])
    whole = [r for b in divergence._documents(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(divergence, "_ENTRIES", 5)
    short = [r for b in divergence._documents(iter([batch])) for r in b.to_pylist()]
    assert len({r["part"] for r in short}) > 5 and len({r["part"] for r in whole}) == 1
    for field in ("n", "documents"):
        assert {k: v for k, v in _sums(short, field).items()} == _sums(whole, field)
    short.sort(key=lambda r: (r["lang"], r["term"].encode(), r["source"], r["part"]))
    scanned = [b for k in (1, 7, 1000) for b in [pa.Table.from_batches(divergence._scan(3)(pa.RecordBatch.from_pylist(short[i : i + k]) for i in range(0, len(short), k))).to_pylist()]]
    drop = lambda rows: [(r["lang"], r["term"], r["source"], r["n"], r["total"], r["sources"], r["head"]) for r in rows]
    assert drop(scanned[0]) == drop(scanned[1]) == drop(scanned[2])


def _sums(rows, field):
    out = Counter()
    for r in rows:
        out[r["lang"], r["term"], r["source"]] += r[field]
    return out


def test_shares_do_not_overflow(spark):
    row = spark.createDataFrame([(10**15, 3 * 10**15), (5, 7), (1, 10**9)], "c long, t long")
    got = [r[0] for r in row.select(divergence._share(F.col("c"), F.col("t"))).collect()]
    assert got == [1 + 10**9 * 10**15 // (3 * 10**15), 1 + 10**9 * 5 // 7, 2]


# --- spelling variants ----------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, times=variants.TIMES):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    form, size = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        size[w] = len(close)
        if close:
            best = min(close, key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], size[w], n[form[w]] if w in form else None))
    return Counter(out)


def grouped(df, **more):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in group_variants(df, **more).collect())


@pytest.fixture(scope="module")
def spelt():
    rng = np.random.default_rng(12)
    base = ["governed", "Française", "überhaupt", "aaaaaaa", "abababab", "colouring", "×÷mutlich"]
    letters = list("abcdefgéß")
    words = []
    for b in base:
        words += [b] * 150
        for _ in range(25):
            at, c = rng.integers(0, len(b)), rng.choice(letters)
            words += [(b[:at] + c + b[at + 1 :], b[:at] + c + b[at:], b[:at] + b[at + 1 :])[rng.integers(0, 3)]] * int(rng.integers(1, 9))
    chain = "zyxwvuts"
    words += [chain] * 400 + [chain + "a"] * 40 + [chain + "ab"] * 4 + ["tiebreak1", "tiesbreak", "tiedbreak"] * 20 + ["tiebreak"] * 2
    words += ["short", "UPPERCASE", "uppercase", "don't-stop", "日本語words語", "w" * 5000, "w" * 5000, "w" * 4999 + "x", "w" * 4999 + "x"]
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40]), None, None) for k in range(40)]
    return rows + [(None, "colouring colouring nullword nullword", None, None), (99, None, None, None), (100, "", None, None), (101, "longword " * 200_000, None, None), rows[3], rows[3]]


def test_variants_equal_plain_version(spark, spelt):
    assert grouped(table(spark, spelt)) == plain_variants(spelt)
    assert grouped(table(spark, spelt[:0])) == Counter()


def test_variants_in_tiles_equal_one_shard(spark, spelt):
    """A shard of one key that is dealt in tiles gives the same pairs, each once."""
    rows = [(k, " ".join(["zzz" + w for w in (t or "").split()]), None, None) for k, t, *_ in spelt if k != 101]
    assert grouped(table(spark, rows), shard=7) == plain_variants(rows)


def test_candidates_lose_no_pair():
    rng = np.random.default_rng(13)
    words = list({"".join(rng.choice(list("ab"), rng.integers(7, 11))) for _ in range(400)})
    held = variants.Words(words)
    found = Counter(frozenset((int(a), int(b))) for first in (True, False) for x, y in variants.near_pairs(held, np.arange(len(words)), first) for a, b in zip(x, y))
    assert found == Counter({frozenset((i, j)): 1 for i in range(len(words)) for j in range(i) if near(words[i], words[j])})


def test_tiles_with_staged_sizes(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("key"))
    tiles = tiled(rows, ["key"], ["id"], 100, work=Workspace(spark, "tiles")).groupBy("_i", "_j").count().collect()
    assert len(tiles) == 20 * 21 // 2 and max(r["count"] for r in tiles) < 400


# --- quality --------------------------------------------------------------------------------------


def test_quality_tells_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op13_quality"](spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in tested if y == 1], [s for s, y in tested if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.3) == (y == 1) for s, y in tested]) > 0.9


def test_quality_edges(spark):
    rng = np.random.default_rng(3)
    good = ["the quick plan of the committee was read and approved by all members present in turn " * 3, "a measured account of how rivers change their course over many years of steady rain " * 3]
    bad = ["BUY!! NOW!! CHEAP!! CLICK!! " * 9, "$$$ ### &&& *** $$$ %%% &&& ### " * 9]
    rows = [(k, f"{rng.choice(good if k % 3 else bad)} {rng.integers(1e9)}", "en", "s") for k in range(300)]
    rows += [(900, None, None, None), (901, "", None, None), (None, good[0], None, None), (902, good[0] * 3000, None, None), (903, bad[0] * 3000, None, None), rows[7], rows[7], (904, "!", None, None)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(5, 0, 0), (None, 1, 0), (17, None, 0), (18, 7, 0)], "doc_id long, quality int, score int")
    got = score_quality(table(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[900].n_bytes == 0 and by[None].held_out is False
    assert by[902].predicted == 1 and by[903].predicted == 0 and by[902].n_bytes == len(good[0]) * 3000
    assert len([r for r in got if r.doc_id == 7]) == 3
    equal = defaultdict(set)
    for k, text, *_ in rows:
        equal[text].add(by[k].score)
    assert all(len(x) == 1 for x in equal.values())
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 3 > 0) for r in held]) > 0.95
    none = score_quality(table(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    one = score_quality(table(spark, rows), labels.where("quality = 0 and doc_id <> 5")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score < 0.1
    assert score_quality(table(spark, rows[:0]), labels).collect() == []


def test_compressed_sizes_are_those_of_the_dictionaries():
    samples = [f"sample number {k} of some plain words that repeat".encode() for k in range(400)]
    built = quality.build_dictionary(samples, 4096)
    assert len(built) <= 4096
    with_it, without = quality.compressor(built), quality.compressor(b"")
    text = b"sample number 77 of some plain words that repeat"
    assert len(with_it.compress(text)) < len(without.compress(text))
    assert quality.build_dictionary([b"only one sample here"], 4096).endswith(b"only one sample here") and quality.build_dictionary([], 10) == b""
    assert b"".join(quality.blocks(text * 40)) == text * 40


def test_line_falls_back_to_the_rate():
    assert quality.fit_line(np.array([]), np.array([])) == (0.0, 0.0)
    assert quality.fit_line(np.array([1.0, 2.0]), np.array([1, 1]))[0] == 0.0
    slope, shift = quality.fit_line(np.array([0.1, 0.2, 0.8, 0.9] * 20), np.array([0, 0, 1, 1] * 20))
    assert slope > 0 and slope * 0.1 + shift < 0 < slope * 0.9 + shift
    assert quality.fit_line(np.array([0.9, 0.1] * 10), np.array([0, 1] * 10))[0] == 0.0
