"""Functions and operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from cartulary.functions import predicates as P
from cartulary.functions import text as T
from cartulary.operators import state as S
from cartulary.operators.evidence import append_new, pool
from cartulary.operators.graph import betweenness
from cartulary.operators.router import route
from cartulary.sources import records as R


def one(df):
    return [tuple(r) for r in df.collect()]


def test_unknown_similarity_is_kept(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 0.72D), (2, 0.30D), (3, CAST(NULL AS DOUBLE)) v(id, s)")
    assert sorted(r[0] for r in one(df.where(P.above_floor(F.col("s"), 0.55)))) == [1, 3]


def test_one_episode_never_promotes(spark):
    lines = spark.createDataFrame([("memory/a.md", "- Candidate: keep it short episode_id: e1"), ("memory/b.md", "- Candidate: keep it short episode_id: e1")], "path string, line string")
    assert pool(lines).first()["decision"] == "HOLD"


def test_append_finds_new_rows_and_conflicts(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    batch = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("c", "3")], "id string, sha string")
    new, conflicts = append_new(store, batch, "id", "sha")
    assert one(new) == [("c", "3")]
    assert one(conflicts) == [("b", "9")]


def test_terminal_state_is_final(spark):
    e = spark.createDataFrame([(1, 1, "running"), (1, 2, "succeeded"), (1, 3, "running"), (2, 1, "running")], "job_id long, seq long, status string")
    assert sorted(one(S.job_states(e))) == [(1, "succeeded", 2, 1), (2, "running", 1, 0)]


def test_stale_limits():
    with pytest.raises(ValueError):
        S.stale(None, None, 10)


def test_router(spark):
    rows = spark.createDataFrame([("好",), ("之前怎麼處理碳盤查的",), ("what is this garden",)], "m string")
    assert [r["trigger"] for r in route(rows, "m").collect()] == ["suppress", "hard", "soft"]


def test_betweenness_of_a_path(spark):
    got = dict(one(betweenness(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"))))
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_sections_and_front_matter(spark):
    text = "---\ntitle: \"A b\"\nsource_url: https://x.org\n---\nhead\n# One\nbody\n## Two\nmore"
    df = spark.createDataFrame([("p", text)], "path string, body string")
    assert df.select(R.front_matter(F.col("body"))["title"]).first()[0] == "A b"
    assert [r["heading"] for r in R.sections(df).orderBy("section_no").collect()] == ["", "One", "Two"]
    assert df.select(T.front_matter_value(F.col("body"), "source_url")).first()[0] == "https://x.org"


def test_markdown_scan(spark, tmp_path):
    for name in ("a.md", "INDEX.md", "sub/b.md", "inbox/c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# x")
    assert R.read_markdown(spark, str(tmp_path)).count() == 2


def test_subtitles(spark):
    vtt = "WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<c>hello</c>\n\n00:01.000 --> 00:02.000\nhello\nworld"
    assert spark.createDataFrame([(vtt,)], "v string").select(R.subtitle_text(F.col("v"))).first()[0] == "hello world"


def test_article_xml(spark):
    xml = "<article><article-title>T</article-title><abstract><p>short</p></abstract><body><p>" + "long words " * 5 + "</p><p>no</p></body></article>"
    got = spark.createDataFrame([(xml,)], "x string").select(R.article(F.col("x")).alias("a")).select("a.*").first()
    assert (got["title"], got["abstract"], len(got["paragraphs"])) == ("T", "short", 1)


def test_index_and_events(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"version": "1", "items": [{"id": "a"}, {"id": "b"}]}')
    (tmp_path / "e.jsonl").write_text('{"id": "a"}\nbroken\n')
    assert R.read_index(spark, str(tmp_path / "i.json"), "id: string").count() == 2
    assert R.read_events(spark, str(tmp_path / "e.jsonl"), "id string").collect()[0]["id"] == "a"


def test_a_large_index_gives_no_rows(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"items": [{"id": "a"}]}')
    assert R.read_index(spark, str(tmp_path / "i.json"), "id: string", most=10).count() == 0


def test_settings_and_principals():
    from cartulary.config import Principal, principal, resolved

    assert [resolved("a", {"a": "1"}, {"a": "2"}, "3"), resolved("a", {"a": ""}, {"a": "2"}, "3"), resolved("a", {}, {}, "3")] == ["1", "2", "3"]
    tokens = {"t": Principal("agent", frozenset({"read"}), "team-a"), "u": Principal("admin", frozenset({"read", "write"}))}
    assert principal(tokens, "t", "read", "team-a").name == "agent" and principal(tokens, "u", "write", "any").name == "admin"
    for token, scope, namespace in (("x", "read", "team-a"), ("t", "write", "team-a"), ("t", "read", "team-b")):
        with pytest.raises(PermissionError):
            principal(tokens, token, scope, namespace)


def test_provider_cache_and_retries(spark):
    from cartulary.operators.providers import answered, composed
    from cartulary.operators.turns import BoundedCache

    asked = []
    cache = BoundedCache(lambda q: asked.append(q) or (1 / 0 if q == "bad" else q), most=2)
    assert [cache("a"), cache("a"), cache("bad"), cache("bad"), cache("c"), cache("a")] == ["a", "a", None, None, "c", "a"] and asked == ["a", "bad", "c", "a"]

    def busy(prompts):
        if len(prompts) > 1 or prompts[0] == "never":
            raise TimeoutError
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "never"), ("3", "z")], "k string, p string").coalesce(1)
    assert {r["k"]: r["answer"] for r in answered(rows, "k", "p", busy).collect()} == {"1": "X", "2": None, "3": "Z"}
    records = spark.createDataFrame([("t1", "a" * 30), ("t2", "b" * 4000)], "title string, text string")
    assert composed("why", records, ["title"], 100) == "[t1]\n" + "a" * 30 + "\n\nQuestion: why"


def test_damaged_vectors_are_not_read(spark):
    from cartulary.sources.store import valid_vectors

    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    with pytest.raises(ValueError):
        valid_vectors(v, 2)
    assert valid_vectors(v.limit(1), 2, 1).count() == 1
