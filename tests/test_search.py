"""Searches for many queries at once, against plain versions: batched recall, set overlaps and nearest vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.operators import batch_recall as B
from cartulary.operators import overlap
from cartulary.operators.nearest import nearest_vectors
from cartulary.operators.overlap import top_overlaps
from cartulary.sources import store

CJK = re.compile("^[一-鿿]+$")


def tokens_of(text, stops=()):
    out = []
    for run in re.findall(r"[A-Za-z0-9_\-]{2,}|[一-鿿]+", text.lower()):
        found = [run] if not CJK.match(run) else ([run] if len(run) <= 3 else []) + [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1)]
        out += [t for t in found if len(t) >= 2 and t not in stops and not (CJK.match(t) and all(c in stops for c in t))]
    return list(dict.fromkeys(out))


def units_of(tokens):
    return {u for t in tokens for u in (t if CJK.match(t) else [t])}


def plain_topk(queries, layer, docs, stops=()):
    out = []
    for q in queries:
        tokens, found = tokens_of(q, stops), []
        for doc, static, *fields in docs:
            own, hit = 0.0, False
            for (name, (weight, bonus)), text in zip(layer.fields.items(), fields):
                low = (text or "").lower()
                held = [t for t in tokens if t in low]
                hit |= bool(held)
                part = {"units": len(units_of(held)) / max(len(units_of(tokens)), 1), "tokens": len(held) / max(len(tokens), 1), "points": len(held)}[layer.share]
                own += weight * part + bonus * sum(a + b in low or f"{a} {b}" in low for a, b in zip(tokens, tokens[1:]))
                if layer.whole and layer.whole[0] == name and tokens and q.lower() in low:
                    own += layer.whole[1]
            score = round(round(static + own, 9) + 1e-12, 3)
            if hit and score >= layer.floor and round(own, 9) >= layer.least:
                found.append((-score, doc))
        out += [(layer.name, q, doc, -s, r + 1) for r, (s, doc) in enumerate(sorted(found)[: layer.limit])]
    return sorted(out)


WORDS = ["the", "then", "other", "roadmap", "plan", "wiki-2", "目前進度", "進度", "目前", "案例分析", "a", "x", "Plan", "READ_me", "the"]


@pytest.mark.parametrize("share,least,whole,tile", [("units", 0.0, None, 4096), ("tokens", 0.2, None, 3), ("points", 0.0, ("body", 4.0), 3)])
def test_batched_recall_equals_plain(spark, monkeypatch, share, least, whole, tile):
    monkeypatch.setattr(B, "TILE", tile)
    monkeypatch.setattr(B, "SEED", 5)
    rng = np.random.default_rng(8)
    text = lambda n: "".join(str(rng.choice(WORDS)) + str(rng.choice([" ", "", "  ", "\n", " ", "."])) for _ in range(rng.integers(0, n)))
    docs = [(f"d{k:03d}", float(rng.choice([0.0, 0.25])), text(4), text(30)) for k in range(80)] + [("none", 0.0, None, None), ("empty", 0.25, "", ""), ("hot", 0.0, "the the", "the " * 3000)]
    queries = sorted({text(7).strip() or "the" for _ in range(25)} | {"the", "目前進度", "!!", "zzz nothing", "the then other"})
    layer = B.Layer("l", spark.createDataFrame(docs, "doc string, static double, title string, body string"), {"title": (3.0, 1.5), "body": (0.5, 0.25)}, share, 0.3, 3, least, whole)
    asked = spark.createDataFrame([("l", q) for q in queries], "layer string, query string")
    postings = B.build_postings([layer], store.new_folder(spark, "test"))
    got = B.batched_topk(asked, [layer], postings, ("the", "目")).collect()
    assert sorted((r.layer, r.query, r.doc, r.score, r["rank"]) for r in got) == plain_topk(queries, layer, docs, ("the", "目"))
    got = B.batched_topk(asked, [layer], postings).collect()
    assert sorted((r.layer, r.query, r.doc, r.score, r["rank"]) for r in got) == plain_topk(queries, layer, docs)


def test_postings_of_a_hot_term_are_never_rows(spark, monkeypatch):
    """A block sends on the best records of a query alone, and ties at its last place go by doc over all blocks."""
    monkeypatch.setattr(B, "TILE", 500)
    sizes, write = {}, store.write
    docs = spark.range(2000, numPartitions=1).select(F.format_string("d%05d", F.col("id")).alias("doc"), F.lit(0.0).alias("static"), F.lit("the then other").alias("body"))
    layer = B.Layer("l", docs, {"body": (0.5, 0.25)}, "units", 0.3, 3)
    postings = B.build_postings([layer], store.new_folder(spark, "test"))
    monkeypatch.setattr(B.store, "write", lambda df, path, *a, **k: sizes.setdefault(path.rsplit("/", 1)[1], write(df, path, *a, **k)))
    got = B.batched_topk(spark.createDataFrame([("l", "the other"), ("l", "zz")], "layer string, query string"), [layer], postings).collect()
    assert sorted((r.query, r.doc, r.score, r["rank"]) for r in got) == [("the other", f"d{k:05d}", 0.5, k + 1) for k in range(3)]
    assert max(x.count() for x in sizes.values()) <= 3 * 2000 / 500


def test_results_need_a_score_and_an_excerpt(spark):
    rows = spark.createDataFrame([(0.3, 15), (0.3, 14), (0.29, 99), (0.9, None)], "s double, n int")
    assert [r[0] for r in rows.select(B.valued(F.col("s"), F.col("n"), F.lit(0.3))).collect()] == [True, False, False, False]


@pytest.mark.parametrize("seed", [1, 64])
def test_overlaps_equal_plain(spark, seed):
    rng = np.random.default_rng(seed)
    element = [f"e{k}" for k in range(30)]
    rows = [(k, ["hot", *rng.choice(element, rng.integers(0, 6)).tolist()]) for k in range(150)] + [(200 + k, ["hot", "also"]) for k in range(300)] + [(900, None), (901, []), (902, [None, "e1", "e1"])]
    queries = [r for r in rows if r[0] % 10 == 0] + [(999, ["unknown"]), (998, ["hot"])]
    schema = "{} long, elements array<string>"
    want = []
    for q, es in queries:
        own = {e for e in es or [] if e}
        met = sorted((-len(own & {e for e in x or [] if e}), i) for i, x in rows if i != q)
        want += [(q, i, -n) for n, i in met if n < 0][:3]
    got = top_overlaps(spark.createDataFrame(queries, schema.format("query")), spark.createDataFrame(rows, schema.format("id")), 3, seed=seed).collect()
    assert sorted((r.query, r.id, r.shared) for r in got) == sorted(want)


def test_a_hot_element_is_not_joined(spark, monkeypatch):
    """A tag that all rows have brings up nothing where rarer ones do."""
    rows = spark.range(4000).select("id", F.array(F.lit("hot"), F.concat(F.lit("r"), (F.col("id") % 400).cast("string")), F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("elements"))
    written = {}
    write = store.write
    monkeypatch.setattr(overlap.store, "write", lambda df, path, *a, **k: written.setdefault(path.rsplit("/", 1)[1], write(df, path, *a, **k)))
    got = top_overlaps(rows.where("id % 100 = 0").withColumnRenamed("id", "query"), rows, 3).collect()
    assert len(got) == 120 and "hot" not in {r.element for r in written["prefix"].select("element").distinct().collect()}


def test_pairs_of_a_hot_element_are_never_rows(spark, monkeypatch):
    """Sets that share one element alone with a query are counted in their block, which sends on the best few."""
    monkeypatch.setattr(overlap, "BLOCK", 200)
    sent, matched = [], overlap._matched
    monkeypatch.setattr(overlap, "_matched", lambda *a: sent.append(matched(*a)) or sent[-1])
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("hot"), F.concat(F.lit("own"), F.col("id").cast("string"))).alias("elements"))
    got = top_overlaps(rows.where("id % 100 = 0").withColumnRenamed("id", "query"), rows, 3, seed=50).collect()
    ids = sorted(map(str, range(1000)))
    assert sorted((r.query, r.id, r.shared) for r in got) == sorted((str(q), i, 1) for q in range(0, 1000, 100) for i in [x for x in ids if x != str(q)][:3])
    assert sent[-1].count() <= 10 * 5 * 4 < 10 * 1000


def test_tokens_meet_the_words_that_hold_them(spark):
    words = ["schule", "hochschule", "schulenburg-schulen", "ab", "abc", "目前進度", "x" * 300, "schulden"]
    tokens = ["sch", "schule", "schulen", "schulenburg", "ab", "abc", "abcd", "進度", "xx", "x" * 20, "hochschulen"]
    of = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = overlap.held_in(of("token", tokens), of("word", words)).collect()
    assert sorted(map(tuple, got)) == sorted((t, w) for t in tokens for w in words if t in w)


def test_nearest_equals_plain_and_prunes(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    v = np.repeat(centre, 60, 0) + rng.normal(size=(720, 16)) * 0.05
    v[5] = v[4]
    rows = [(k, k % 2, x.tolist()) for k, x in enumerate(v)] + [(800, 0, None), (801, 0, [0.0] * 16), (802, 1, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, part int, embedding array<double>").repartition(4)
    queries = table.where("vec_id % 20 = 4").withColumnRenamed("vec_id", "q")
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    s = np.round(u @ u.T, 6)
    for by in ((), ("part",)):
        want = []
        for q in range(4, 720, 20):
            near = sorted((-s[q, i], i) for i in range(720) if i != q and (not by or i % 2 == q % 2) and s[q, i] >= 0.2)
            want += [(q, i, -x) for x, i in near[:7]]
        found = nearest_vectors(queries, table, 7, 0.2, by, block=16).collect()
        assert sorted((r.q, r.vec_id, r.similarity) for r in found) == sorted(want)
    read = nearest_vectors(queries, table, 7, 0.2, block=16, visits_only=True).agg(F.sum("rows")).first()[0]
    assert read < 0.3 * 36 * 720  # each query is compared with few rows outside its cluster
    assert nearest_vectors(queries, table.where("false"), 7).collect() == [] and nearest_vectors(queries.where("false"), table, 7).collect() == []
