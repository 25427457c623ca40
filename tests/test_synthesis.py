"""Packing, trees of calls and batches: nothing lost, nothing twice, nothing beyond the budget."""

import re

import pytest
from pyspark.sql import functions as F

from cartulary.operators import synthesis as S

ROWS = [("hot", i, f"n={i} " + "x" * (i % 90)) for i in range(600)] + [("one", 1, "n=7")] + [("long", i, f"n={i} " + "y" * 5000) for i in range(5)] + [(None, 1, "n=1"), ("void", 1, ""), ("void", 2, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "topic string, i int, text string").repartition(7)


def test_places_do_not_depend_on_tasks(spark, rows, tmp_path):
    got = S.placed(rows.where("text <> ''"), "topic", ["i"], F.length("text"), f"file://{tmp_path}/a").collect()
    at, n = {}, {}
    for topic, i, text in sorted((r for r in ROWS if r[0] and r[2]), key=lambda r: r[:2]):
        n[topic, i], at[topic, i] = sum(k[0] == topic for k in n), sum(len(r[2]) for r in ROWS if r[0] == topic and r[1] < i)
    assert {(r.topic, r.i): (r["_n"], r["_at"]) for r in got} == {k: (n[k], at[k]) for k in n}


def test_prompts_hold_each_text_once_and_keep_to_the_budget(rows, tmp_path):
    packs = S.packed(rows, "topic", ["i"], "text", f"file://{tmp_path}/p", 400).collect()
    assert all(len(p.text) <= 400 for p in packs)
    for topic in ("hot", "one", "long"):
        own = sorted((p for p in packs if p.topic == topic), key=lambda p: p.prompt)
        assert [p.prompt for p in own] == list(range(len(own)))
        assert "\n".join(p.text for p in own).split("\n") == [t[:99] for g, _, t in ROWS if g == topic]
    assert {p.topic for p in packs} == {"hot", "one", "long"}


def test_a_tree_holds_every_text_once(rows):
    def summing(prompts):
        """Adds up the lines n=... of a prompt: the same in any tree that holds each text once."""
        assert all(len(p) <= 400 for p in prompts)
        return [f"n={sum(int(x) for x in re.findall(r'(?m)^n=([0-9]+)', p))}" for p in prompts]

    got = {r.topic: r for r in S.synthesised(rows, "topic", ["i"], "text", summing, budget=400).collect()}
    assert {t: r.text for t, r in got.items()} == {"hot": f"n={sum(range(600))}", "one": "n=7", "long": "n=10"}
    assert got["one"].levels == 1 and got["hot"].levels >= 3 and not any(r.lost for r in got.values())


def test_long_texts_and_answers_are_used_to_their_ends(spark):
    """Every word is in a prompt, and so is every word of an answer that the next level is asked about."""
    texts = [("a", 1, " ".join(f"w{k}" for k in range(900))), ("a", 2, "w900"), ("cjk", 1, "進" * 3001), ("line", 1, "n=1 " + "x" * 94 + "n=5" * 99)]
    told = spark.createDataFrame(texts, "topic string, i int, text string")

    def counting(prompts):
        """How many words and characters of a prompt are distinct words, or 進, with those that its lines count; of a length that no quarter of a budget holds."""
        assert all(len(p) <= 400 for p in prompts)
        n = [len(re.findall(r"\bw\d+\b", p)) + p.count("進") + sum(int(x) for x in re.findall(r"#(\d+)#", p)) + sum(int(x) for x in re.findall(r"(?m)^n=(\d+)", p)) for p in prompts]
        return ["." * 120 + f" #{x}#" for x in n]

    got = {r.topic: (r.text.strip(". "), r.lost) for r in S.synthesised(told, "topic", ["i"], "text", counting, budget=400).collect()}
    assert got == {"a": ("#901#", 0), "cjk": ("#3001#", 0), "line": ("#1#", 0)}


def test_pieces_are_the_whole_text(spark):
    texts = ["", "ab", "one two three four", "one  two\n three", "x" * 31, "ab " + "x" * 25 + " cd", " " * 25, "\U0001f600" * 12]
    rows = S.pieces(spark.createDataFrame([("g", k, t) for k, t in enumerate(texts)], "g string, i int, t string"), "g", ["i"], "t", 10).collect()
    for k, t in enumerate(texts):
        own = [r.t for r in sorted((r for r in rows if r.i == k), key=lambda r: r["_piece"])]
        assert all(len(x) <= 10 for x in own) and all(x[0].isspace() for x in own[1:])
        joined = "".join(own)
        assert joined == t if max(map(len, t.split()), default=0) < 9 else re.sub(r"\s", "", joined) == re.sub(r"\s", "", t)


def test_answers_that_do_not_get_shorter_end(rows):
    """They are no endless tree and no silent cut: the group has no text, and its prompts count as lost."""
    got = {r.topic: r for r in S.synthesised(rows, "topic", ["i"], "text", lambda prompts: [p if len(p) > 10 else "ok" for p in prompts], budget=400).collect()}
    assert got["one"].text == "ok" and got["one"].lost == 0
    assert got["hot"].text is None and got["hot"].lost > 1 and got["long"].text is None


def test_calls_that_fail_are_counted(rows):
    fails = lambda prompts: [None if "y" in p or "n=7" == p else "n=0" for p in prompts]
    got = {r.topic: (r.text, r.lost > 0) for r in S.synthesised(rows, "topic", ["i"], "text", fails, budget=400).collect()}
    assert got == {"hot": ("n=0", False), "one": (None, True), "long": (None, True)}


def test_batches_keep_their_first_bullets(spark):
    notes = spark.createDataFrame([("t", i, f"- note {i}") for i in range(95)] + [("u", 1, "- only")], "topic string, i int, note string")
    page = spark.createDataFrame([("t", "p" * 2000)], "topic string, page string")

    def answer(prompts):
        return [None if "only" in p else "<think>- no</think>Here:\n" + f"- {p.count('- note')} notes, {p.count('p')} shown\n  and more\n- b\n- c" for p in prompts]

    got = {r.topic: r for r in S.concluded(notes, "topic", ["i"], "note", answer, page, keep=2).collect()}
    assert got["t"].text == "\n\n".join(f"- {n} notes, 1500 shown and more\n- b" for n in (40, 40, 15))
    assert (got["t"].batches, got["t"].lost, got["u"].batches, got["u"].lost, got["u"].text) == (3, 0, 1, 1, "")


def test_suggestions_that_cannot_be_read(spark):
    items = spark.createDataFrame([(c, f"t{i}", i) for c in ("good", "fenced", "bad", "none") for i in range(9)] + [(None, "x", 1)], "category string, title string, doc_id int")
    existing = spark.createDataFrame([("old",)], "slug string")

    def answer(prompts):
        assert all("  - t7" in p and "t8" not in p and p.endswith("  - old") for p in prompts)
        said = {"good": '{"topics": ["a"], "reason": "r", "confidence": "high"}', "fenced": '```json\n{"topics": null, "reason": "few"}\n```', "bad": "no " * 90}
        return [said.get(p.split(" ")[0]) for p in prompts]

    got = {r.category: (r.n, r.topics, r.reason, r.confidence) for r in S.suggested_topics(items, existing, answer, ["doc_id"]).collect()}
    assert got == {"good": (9, ["a"], "r", "high"), "fenced": (9, None, "few", "low"), "bad": (9, None, "unreadable: " + ("no " * 90)[:120], "low"), "none": (9, None, "unreadable: ", "low")}


def test_answers_by_situation(spark):
    questions = spark.createDataFrame([(1, "why", "enrichment"), (2, "why", "continuity"), (3, "why", "direct"), (4, "how", "enrichment"), (5, None, None)], "id int, question string, situation string")
    hits = [(i, "card", k, f"c{k}", "z" * 900, "" if k == 1 else f"http://{k}") for i in (1, 2, 3) for k in range(9)] + [(i, "wiki", 0, "w", "v" * 2000, "http://w") for i in (1, 2, 3)]
    echo = lambda prompts: list(prompts)
    got = {r.id: r for r in S.composed_answers(questions, spark.createDataFrame(hits, "id int, kind string, rank int, title string, text string, url string"), echo).collect()}
    told = "[w]\n" + "v" * 1200 + "".join(f"\n\n[c{k}]\n" + "z" * 400 for k in range(9))
    links = "\n\nLinks:\n" + "\n".join(f"- [c{k}](http://{k})" for k in (0, 2, 3, 4, 5))
    assert got[1].text == told + links + "\n\nQuestion: why" and got[1].links == 5
    assert got[2].text == told + "\n\nQuestion: why" and got[2].links == 0
    assert (got[3].text, got[4].text, got[3].grounded, got[5].text) == ("why", "how", False, "")


def test_judged_pairs_and_their_report(spark):
    cards = spark.createDataFrame([(1, "a", "One"), (2, "a", "one!"), (3, "a", None), (4, "b", "Two"), (5, "b", ""), (6, "b", ""), (7, None, "x")], "id int, category string, title string").withColumn("summary", F.lit(None).cast("string"))
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (3, 4, 0.8), (4, 5, 0.7), (1, 99, 0.7)], "a int, b int, similarity double")

    def answer(prompts):
        return [None if p.startswith("Two") else "RELATION: CONFLICT\nREASON:  they differ \n" if "one!" in p else "RELATION: CONFLICT" if "Two" in p else "well" for p in prompts]

    judged = S.judged_pairs(pairs, cards, answer)
    assert {(r.a, r.b): (r.relation, r.reason, r.notable) for r in judged.collect()} == {(1, 2): ("CONFLICT", "they differ", ""), (1, 3): ("UNKNOWN", "", ""), (3, 4): ("CONFLICT", "", "")}
    gaps = spark.createDataFrame([("a", "much")], "category string, text string")
    report = {r.category: tuple(r)[1:] for r in S.health_report(cards, judged, gaps).collect()}
    assert report == {"a": (3, 2, 1, 1, "one", "much"), "b": (3, 0, 0, 0, "", None)}
    empty = S.health_report(cards.limit(0), judged.limit(0), gaps)
    assert empty.columns == ["category", "cards", "judged", "conflicts", "duplicates", "examples", "gaps"] and empty.collect() == []
