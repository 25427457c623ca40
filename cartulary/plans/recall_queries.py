"""Recall over items, notes, sections and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.operators import notes as N
from cartulary.operators import recall as R
from cartulary.operators.ranking import card_score, top
from cartulary.plans.base import query
from cartulary.plans.note_queries import _ROWS
from cartulary.plans.rank_queries import _ADJUST, _CLEAN
from cartulary.sources import store
from cartulary.sources.records import items, note_sections, notes, table

_TOKENS = ["the", "src1", "en"]
#: A topic profile: weights of categories and tags. Configuration.
_PROFILE = ({"en": 0.9, "de": 0.5}, {"src1": 0.7, "q9": 0.2})
_MATCH = R.profile_matches(_TOKENS, *_PROFILE)
_BONUS = "CASE WHEN category = 'en' THEN 0.108 WHEN list_contains(tags, 'src1') THEN 0.072 ELSE 0 END"
_ALL = f"round(({_ADJUST} + {_BONUS})::DOUBLE, 4)"
_HIDE = rf"(excluded OR regexp_matches(trim(title), '^[0-9]{{15,20}}$') OR ({_CLEAN} IN ('', '待整理') AND (source_url = '' OR category = 'general' OR regexp_matches(lower(trim(title)), '^tweet\s+[0-9]{{15,20}}$'))))"


@query(f"SELECT doc_id, {_ALL} AS adjustment FROM items", items=True)
def topic_adjustments(spark, sf_dir):
    """All adjustments, with the bonus of a topic profile's category or tag."""
    return items(spark, sf_dir).select("doc_id", R.all_adjustments(_MATCH).alias("adjustment"))


def _vectors(spark, sf_dir):
    """Two point vectors for each item, keyed by its path."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") / 2).cast("long").alias("doc_id"), F.concat(F.lit("#kp"), (F.col("vec_id") % 2).cast("string")).alias("point"), "embedding")
    return items(spark, sf_dir).select("doc_id", "path").join(e, "doc_id").select(F.concat("path", "point").alias("key"), "embedding")


def _query_vector(spark, sf_dir) -> list[float]:
    """A query's vector, as a provider would give it: here that of vector 0, one row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


_KW = "((contains(x, 'the')::INT + contains(x, 'src1')::INT + contains(x, 'en')::INT) / 3.0)"
_BEST = "SELECT vec_id // 2 AS doc_id, max(round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)) AS similarity FROM embeddings GROUP BY 1"
_SEMANTIC = f"""SELECT path, similarity, round((0.65 * similarity + 0.35 * {_KW} + {_ALL})::DOUBLE, 4) AS score FROM (SELECT *, lower(title) || ' ' || lower(array_to_string(tags, ' ')) || ' ' || lower(summary) AS x FROM items)
  JOIN (SELECT b.* FROM ({_BEST}) b JOIN items p USING (doc_id) WHERE similarity >= 0.05 ORDER BY similarity DESC, path LIMIT 20) USING (doc_id) WHERE NOT {_HIDE} ORDER BY score DESC, path LIMIT 10"""


def _semantic(spark, sf_dir):
    return R.semantic_recall(_vectors(spark, sf_dir), items(spark, sf_dir), _query_vector(spark, sf_dir), _TOKENS, _MATCH, 10, cut=0.05).select("path", "similarity", "score")


@query(_SEMANTIC, items=True)
def semantic_cards(spark, sf_dir):
    """The best vector of each card, twice the limit, the cut, then keywords and adjustments. The cut is lower than the default's 0.25, as these vectors are far less alike."""
    return _semantic(spark, sf_dir)


@query(f"SELECT *, 'semantic' AS mode, 'hybrid: empty' AS passed FROM ({_SEMANTIC})", items=True)
def backend_ladder(spark, sf_dir):
    """The hybrid backend finds nothing, so the semantic one answers, and says so."""
    cards = _semantic(spark, sf_dir)
    keyword = top(items(spark, sf_dir).withColumn("score", card_score(_TOKENS, " ".join(_TOKENS)).cast("double")), 10, F.desc("score"), "path").select("path", F.lit(None).cast("double").alias("similarity"), "score")
    return R.first_backend([("hybrid", cards.where("similarity > 2")), ("semantic", cards), ("keyword", keyword)])


@query("SELECT path, n AS score, 'keyword' AS mode, 'hybrid: PythonException, semantic: empty' AS passed FROM (SELECT path, len(title) AS n FROM items ORDER BY n DESC, path LIMIT 10)", items=True)
def backend_failures(spark, sf_dir):
    """The hybrid backend's service fails in its task, the semantic one finds nothing above its cut, so keywords answer, and the result says why."""

    def refused(batches):
        for _ in batches:
            raise ConnectionError("no service")
        yield from ()

    i = items(spark, sf_dir)
    hits = i.select("path", F.length("title").cast("long").alias("score"))
    backends = [("hybrid", lambda: hits.mapInArrow(refused, hits.schema)), ("semantic", lambda: hits.where("score > 1000000")), ("keyword", lambda: top(hits, 10, F.desc("score"), "path"))]
    return R.first_backend(backends)


_T2 = ["the", "notes", "tion"]
_SECSCORE = " + ".join(f"CASE WHEN contains(lower(heading), '{t}') THEN 6 WHEN contains(lower(heading || ' ' || body), '{t}') THEN 2 ELSE 0 END" for t in _T2)
_LINES = "trim(left(array_to_string(list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '^-{3,}$')), ' '), 240))"


@query(
    f"SELECT doc_id, section_no, heading, score, CASE WHEN len(x) >= 240 THEN regexp_replace(x, ' [^ ]*$', '') || '…' ELSE x END AS excerpt FROM (SELECT *, {_LINES} AS x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section_no) AS r FROM (SELECT *, {_SECSCORE} AS score FROM sections WHERE body <> '') WHERE score >= 4) WHERE r = 1 ORDER BY score DESC, doc_id LIMIT 20)",
    views=("sections",),
)
def section_recall(spark, sf_dir):
    """The best section of each note, twenty of them, with excerpts."""
    return R.section_recall(note_sections(spark, sf_dir), _T2, 20).select("doc_id", "section_no", "heading", F.col("score").cast("int").alias("score"), "excerpt")


def _phrase(of: str, tokens: list[str], bonus: float = 0.5) -> str:
    hits = " + ".join(f"contains(lower({of}), '{t}')::INT" for t in tokens)
    pairs = " + ".join(f"(contains(lower({of}), '{a}{b}') OR contains(lower({of}), '{a} {b}'))::INT" for a, b in zip(tokens, tokens[1:]))
    return f"(({hits})::DOUBLE / {len(tokens)} + {bonus}::DOUBLE * ({pairs}))"


_T3 = ["not", "es", "the"]


@query(
    f"SELECT doc_id, section_no, round(2.0 * {_phrase('heading', _T3)} + 0.5 * {_phrase('body', _T3)}, 3) AS score FROM sections WHERE body <> '' AND round(2.0 * {_phrase('heading', _T3)} + 0.5 * {_phrase('body', _T3)}, 3) >= 0.3 ORDER BY score DESC, doc_id, section_no LIMIT 30",
    views=("sections",),
)
def memory_sections(spark, sf_dir):
    """Sections by phrase scores of heading and body."""
    return R.continuity_sections(note_sections(spark, sf_dir), _T3, 30).select("doc_id", "section_no", "score")


_TOPICS = f"topics AS (SELECT doc_id, {{}} AS title, regexp_extract(body, '(?m)^tags:\\s*(.*)$', 1) AS tags, regexp_replace(body, '\\A---\\n(?s:.*?)\\n---\\n', '') AS body FROM notes)".format(_ROWS.split("body, ", 1)[1].split(" AS title")[0])
_TSCORE = f"round(3.0 * {_phrase('title', _T3)} + 1.5 * {_phrase('tags', _T3)} + 0.4 * {_phrase('body', _T3)}, 3)"


def _topics(spark, sf_dir):
    b = F.col("body")
    return notes(spark, sf_dir).select("doc_id", N.note_title(b, F.col("stem")).alias("title"), F.regexp_extract(b, r"(?m)^tags:\s*(.*)$", 1).alias("tags"), F.regexp_replace(b, r"\A---\n(?s:.*?)\n---\n", "").alias("body"))


@query(
    f"""SELECT t.doc_id, t.score, CASE WHEN s.heading IS NULL OR s.heading = '' THEN t.title ELSE s.heading END AS section FROM (SELECT *, {_TSCORE} AS score FROM topics WHERE {_TSCORE} >= 0.4 ORDER BY score DESC, doc_id LIMIT 20) t
  LEFT JOIN (SELECT doc_id, heading FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY 2.0 * {_phrase('heading', _T3)} + {_phrase('body', _T3)} DESC, section_no) AS r FROM sections WHERE 2.0 * {_phrase('heading', _T3)} + {_phrase('body', _T3)} > 0) WHERE r = 1) s ON t.doc_id = s.doc_id""",
    views=("sections",), ctes=_TOPICS,
)
def topic_recall(spark, sf_dir):
    """Topics by title, tags and body, with their best section."""
    topics = store.write(_topics(spark, sf_dir), store.new_folder(spark, "notes"))  # the view's strings are put together once
    return R.continuity_topics(topics, _T3, 20).select("doc_id", "score", "section")


_SIGNALS = "(?i)(?:" + "|".join(R.CONTRARIAN) + "|sch)"
_REL = "((contains(lower(heading || ' ' || body), 'notes')::INT + contains(lower(heading || ' ' || body), 'und')::INT + contains(lower(heading || ' ' || body), 'zz')::INT) / 3.0)"


@query(
    f"SELECT doc_id, section_no, signals, round((0.6 * {_REL} + 0.4 * least(signals / 5.0, 1.0))::DOUBLE, 3) AS score FROM (SELECT *, len(regexp_extract_all(body, '{_SIGNALS}')) AS signals FROM sections WHERE len(trim(body)) >= 20) WHERE signals > 0 AND {_REL} >= 0.15 ORDER BY score DESC, doc_id, section_no LIMIT 40",
    views=("sections",),
)
def contrarian_sections(spark, sf_dir):
    """Sections that contradict. A syllable is added to the signals, as invented prose has few of them."""
    return R.contrarian_sections(note_sections(spark, sf_dir), ["notes", "und", "zz"], 40, (*R.CONTRARIAN, "sch")).select("doc_id", "section_no", F.col("signals").cast("long").alias("signals"), "score")


@query(
    """SELECT doc_id, CASE WHEN len(coalesce(b, left(body, 200))) > 200 THEN left(coalesce(b, left(body, 200)), 200) || '…' ELSE coalesce(b, left(body, 200)) END AS sentence FROM notes LEFT JOIN (
  SELECT doc_id, arg_min(x, (-s, i)) AS b FROM (SELECT doc_id, i, trim(x) AS x, (0.4::DOUBLE * len(regexp_extract_all(trim(x), '%s')) + 0.6::DOUBLE * (contains(lower(trim(x)), 'the')::INT + contains(lower(trim(x)), 'und')::INT) / 2)  AS s
    FROM (SELECT doc_id, unnest(string_split_regex(body, '[。！？\n]')) AS x, unnest(range(len(string_split_regex(body, '[。！？\n]')))) AS i FROM notes) WHERE len(trim(x)) >= 10) WHERE s > 0 GROUP BY doc_id) USING (doc_id)"""
    % _SIGNALS,
    views=("notes",),
)
def signal_sentences(spark, sf_dir):
    """of each note the sentence that says most."""
    return notes(spark, sf_dir).select("doc_id", R.signal_sentence(F.col("body"), ["the", "und"], (*R.CONTRARIAN, "sch")).alias("sentence"))


_T4 = ["github", "star", "en"]


def _asset(of: str, tokens: list[str]) -> str:
    hits = " + ".join(f"contains(lower({of}), '{t}')::INT" for t in tokens)
    pairs = " + ".join(f"(contains(lower({of}), '{a}{b}') OR contains(lower({of}), '{a} {b}'))::INT" for a, b in zip(tokens, tokens[1:]))
    return f"round((({hits})::DOUBLE / {len(tokens)} + 0.3::DOUBLE * ({pairs})), 3)"


_ACTS = "(?i)(?:" + "|".join(R.ACTION) + "|sch)"
_NAMED = "regexp_replace(stem, '[_-]', ' ', 'g')"


@query(
    f"""SELECT kind, path, name, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, kind DESC, name DESC) AS r FROM (
  (SELECT 'script' AS kind, path, stem AS name, {_asset(_NAMED + " || ' ' || stem", _T4)} AS score FROM notes WHERE folder = 'cards/' AND {_asset(_NAMED + " || ' ' || stem", _T4)} >= 0.2 ORDER BY score DESC, path LIMIT 3)
  UNION ALL (SELECT kind, path, name, score FROM (SELECT 'wiki_section' AS kind, path, heading AS name, {_asset("heading || ' ' || body", _T4)} AS score, section_no FROM sections WHERE regexp_matches(heading || chr(10) || body, '{_ACTS}')) WHERE score >= 0.15 ORDER BY score DESC, path, section_no LIMIT 2)
  UNION ALL (SELECT 'plan' AS kind, path, stem AS name, {_asset(_NAMED, _T4)} AS score FROM notes WHERE folder LIKE '%inbox/' AND {_asset(_NAMED, _T4)} >= 0.2 ORDER BY score DESC, path LIMIT 2))) WHERE r = 1 ORDER BY score DESC, path LIMIT 4""",
    views=("sections",),
)
def actions(spark, sf_dir):
    """Scripts, sections and plans that can be acted on, the best of each path."""
    n = notes(spark, sf_dir)
    scripts = n.where("folder = 'cards/'").select("path", F.col("stem").alias("name"))
    plans = n.where("folder like '%inbox/'").select("path", F.col("stem").alias("name"))
    return R.action_recall(scripts, note_sections(spark, sf_dir), plans, _T4, 4, (*R.ACTION, "sch"))


_Q = "the Notes of en"
_QT = R.question_tokens(_Q)


def _sum(weights: dict[str, float], tokens: list[str]) -> str:
    return " + ".join(f"{w}::DOUBLE * contains({of}, '{t}')::INT" for t in tokens for of, w in weights.items())


_TQ = f"{_sum({'lower(title)': 5, 'lower(tags)': 3, 'lower(body)': 1}, _QT)} + 8::DOUBLE * contains(lower(title), '{_Q.lower()}')::INT + 4::DOUBLE * contains(lower(body), '{_Q.lower()}')::INT"
_CT = "lower(array_to_string(tags, ' '))"
_CQ = f"{_sum({'lower(title)': 8, _CT: 6, 'lower(summary)': 3, 'lower(searchable)': 1}, _QT)} + 8::DOUBLE * contains(lower(searchable), '{_Q.lower()}')::INT + 2::DOUBLE * (summary <> '')::INT"


@query(f"SELECT doc_id, {_TQ} AS score FROM topics WHERE {_TQ} > 0 ORDER BY score DESC, doc_id LIMIT 25", views=("notes",), ctes=_TOPICS)
def question_topics(spark, sf_dir):
    """Topics by a question's tokens."""
    s = R.topic_question_score(_QT, _Q, F.col("title"), F.col("tags"), F.col("body"))
    return top(_topics(spark, sf_dir).withColumn("score", s).where("score > 0"), 25, F.desc("score"), "doc_id").select("doc_id", "score")


@query(f"SELECT doc_id, {_CQ} AS score FROM items WHERE {_CQ} >= 5 ORDER BY score DESC, doc_id LIMIT 25", items=True)
def question_cards(spark, sf_dir):
    """Cards by a question's tokens, five points at least."""
    s = R.card_question_score(_QT, _Q, F.col("title"), F.col("tags"), F.col("summary"), F.col("searchable"))
    return top(items(spark, sf_dir).withColumn("score", s).where("score >= 5"), 25, F.desc("score"), "doc_id").select("doc_id", "score")


@query(
    f"SELECT conv_id, turn, CASE WHEN regexp_matches(message, '(?i){R.CONTINUITY}') THEN 'continuity' WHEN 2 * len(regexp_extract_all(lower(message), 'the')) >= 8 OR len(message) % 5 >= 3 THEN 'enrichment' ELSE 'direct' END AS situation FROM messages",
    views=("messages",),
)
def question_situations(spark, sf_dir):
    """What a message needs, by its words, the score of its topic and the number of its cards (both made up from its text)."""
    from cartulary.sources.records import messages

    m = F.col("message")
    return messages(spark, sf_dir).select("conv_id", "turn", R.situation(m, 2.0 * F.regexp_count(F.lower(m), F.lit("the")), F.length(m) % 5).alias("situation"))


@query(
    r"""SELECT doc_id, md5(CASE WHEN len(body) <= 600 THEN body ELSE trim(out, chr(10) || ' ') END) AS excerpt FROM topics JOIN (
  SELECT doc_id, string_agg(CASE WHEN NOT over THEN x || chr(10) || chr(10) WHEN r = first AND 600 - before > 100 THEN left(x, (600 - before)::INT) || '…' ELSE '' END, '' ORDER BY r) AS out FROM (
    SELECT *, coalesce(min(CASE WHEN over THEN r END) OVER (PARTITION BY doc_id), 1000000) AS first FROM (
      SELECT *, before + len(x) > 600 AS over FROM (SELECT *, coalesce(sum(len(x) + 2) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, i) AS r FROM (SELECT doc_id, i, x, CASE WHEN contains(left(lower(x), 200), 'the') THEN 3 WHEN contains(lower(x), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(left(lower(x), 200), 'und') THEN 3 WHEN contains(lower(x), 'und') THEN 1 ELSE 0 END AS p
          FROM (SELECT doc_id, unnest(parts) AS x, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(regexp_replace(body, '\n(#{1,3} )', chr(1) || '\1', 'g'), chr(1)) AS parts FROM topics)))))))
  WHERE r <= first GROUP BY doc_id) USING (doc_id)""",
    views=("notes",), ctes=_TOPICS,
)
def topic_excerpts(spark, sf_dir):
    """Of each topic what fits into 600 characters, the best sections first."""
    return _topics(spark, sf_dir).select("doc_id", F.md5(R.topic_excerpt(F.col("body"), ["the", "und"], 600)).alias("excerpt"))


_RECORDS = """records AS (SELECT 'card' AS kind, id, title || ' ' || summary || ' ' || array_to_string(tags, ' ') || ' ' || source_url AS blob, sensitivity, namespace FROM items UNION ALL
  SELECT 'wiki', stem, stem || ' ' || body, nullif(trim(regexp_extract(body, '(?m)^sensitivity:\\s*(.*)$', 1)), ''), nullif(trim(regexp_extract(body, '(?m)^namespace:\\s*(.*)$', 1)), '') FROM notes)""".replace("\\\\", "\\")
_MAY = "(coalesce(lower(sensitivity), 'private') = 'public' OR coalesce(namespace = 'team-a', false))"
_HITS = "(len(lower(blob)) - len(replace(lower(blob), 'the', ''))) // 3 + (len(lower(blob)) - len(replace(lower(blob), 'src1', ''))) // 4"


def _records(spark, sf_dir):
    cards = items(spark, sf_dir).select(F.lit("card").alias("kind"), "id", F.concat_ws(" ", "title", "summary", F.array_join("tags", " "), "source_url").alias("blob"), "sensitivity", "namespace")
    field = lambda k: F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    wiki = notes(spark, sf_dir).select(F.lit("wiki").alias("kind"), F.col("stem").alias("id"), F.concat_ws(" ", "stem", "body").alias("blob"), field("sensitivity").alias("sensitivity"), field("namespace").alias("namespace"))
    return cards.unionByName(wiki)


@query(f"SELECT kind, id, ({_HITS})::INT AS score FROM records WHERE {_MAY} AND {_HITS} > 0 ORDER BY score DESC, kind, id LIMIT 30", views=("items", "notes"), ctes=_RECORDS)
def catalog_records(spark, sf_dir):
    """Cards and topics that a namespace may see, by occurrences of the terms."""
    return R.catalog_search(_records(spark, sf_dir), ["the", "src1"], "team-a", 30)[0].select("kind", "id", F.col("score").cast("int").alias("score"))


@query(
    f"SELECT card, wiki, conversation, card + wiki + conversation AS total, CASE WHEN card + wiki > 0 THEN 'semantic_backend_unavailable_or_empty; keyword fallback used|records_filtered_by_acl' ELSE 'semantic_backend_unavailable_or_empty; keyword fallback used' END AS warnings FROM (SELECT count(*) FILTER (kind = 'card') AS card, count(*) FILTER (kind = 'wiki') AS wiki, 0::BIGINT AS conversation FROM records WHERE NOT {_MAY})",
    views=("items", "notes"), ctes=_RECORDS,
)
def filtered_layers(spark, sf_dir):
    """What the rights kept back, by layer and in all, and the warnings that follow."""
    kept = R.catalog_search(_records(spark, sf_dir), ["the", "src1"], "team-a", 30)[1]
    n = kept.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("filtered"))), F.lit(0)).cast("long").alias(k) for k in ("card", "wiki", "conversation")])
    n = n.withColumn("total", F.col("card") + F.col("wiki") + F.col("conversation"))
    return n.withColumn("warnings", F.array_join(R.recall_warnings(F.lit("keyword_fallback"), F.lit(0), F.col("total")), "|"))


@query(
    "SELECT doc_id, layer, CASE WHEN swap THEN similarity ELSE score END AS score, CASE WHEN swap THEN score END AS rank_score FROM (SELECT *, layer IN ('card', 'youtube') AND similarity IS NOT NULL AS swap FROM (SELECT i.doc_id, i.source_type AS layer, 0.5::DOUBLE + i.doc_id % 10 / 100.0::DOUBLE AS score, b.similarity FROM items i LEFT JOIN (" + _BEST + ") b USING (doc_id))) WHERE NOT (layer IN ('card', 'youtube')) OR similarity IS NULL OR similarity >= 0.1",
    items=True,
)
def relevance_swap(spark, sf_dir):
    """Cards below the floor go, unknown ones stay; the similarity becomes the score. (The floor is lower than 0.55, as these vectors are far less alike.)"""
    best = R.best_of_card(_vectors(spark, sf_dir), _query_vector(spark, sf_dir))
    rows = items(spark, sf_dir).join(best, F.col("path") == F.col("card"), "left").select("doc_id", F.col("source_type").alias("layer"), (0.5 + F.col("doc_id") % 10 / 100.0).alias("score"), "similarity")
    return R.relevant(rows, "similarity", 0.1, ("card", "youtube")).select("doc_id", "layer", "score", "rank_score")


@query(
    r"""SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM (SELECT q.id AS query, i.id, count(*) AS score FROM (
    SELECT id, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || summary), '[A-Za-z0-9_\-]{2,}'))) AS token FROM items WHERE doc_id % 100 = 0) q JOIN (SELECT id, string_split(array_to_string(regexp_extract_all(lower(title || ' ' || summary || ' ' || array_to_string(tags, ' ')), '[A-Za-z0-9_\-]{2,}|[一-鿿]{2,}'), chr(1)), chr(1)) AS words FROM items) i
    ON len(list_filter(i.words, lambda w: contains(w, q.token))) > 0 AND q.id <> i.id GROUP BY 1, 2) WHERE score >= 2) WHERE r <= 3""",
    items=True,
)
def related_cards(spark, sf_dir):
    """The three items that contain most of the words of a title and summary, two at least. A search: queries are the items whose id is divisible by 100."""
    i = items(spark, sf_dir)
    q = i.where("doc_id % 100 = 0").select(F.col("id").alias("query"), F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(r"[A-Za-z0-9_\-]{2,}"), F.lit(0)).alias("tokens"))
    return R.related(q, i, "id", 3, 2)


@query(
    "SELECT doc_id, CASE WHEN len(r) > 0 THEN array_to_string(r[1:2], '；') ELSE '主題與當前對話高度相關' END AS reason FROM (SELECT doc_id, list_filter([CASE WHEN len(t) > 0 THEN '標題命中：' || array_to_string(t[1:3], '、') END, CASE WHEN len(g) > 0 THEN '標籤接近：' || array_to_string(g[1:3], '、') END, CASE WHEN len(c) > 0 THEN '分類相關：' || array_to_string(c[1:3], '、') END, CASE WHEN len(s) > 0 AND len(t) + len(g) + len(c) = 0 THEN '摘要語意接近：' || array_to_string(s[1:3], '、') END, '命中使用者高頻分類：en'], lambda x: x IS NOT NULL) AS r FROM (SELECT doc_id, list_filter(['the', 'src1', 'en'], lambda k: contains(lower(title), k)) AS t, list_filter(['the', 'src1', 'en'], lambda k: contains(lower(array_to_string(tags, ' ')), k)) AS g, list_filter(['the', 'src1', 'en'], lambda k: contains(lower(category), k)) AS c, list_filter(['the', 'src1', 'en'], lambda k: contains(lower(summary), k)) AS s FROM items))",
    items=True,
)
def relevance_reasons(spark, sf_dir):
    """Why an item is shown, two reasons at most."""
    t = F.array(*[F.lit(x) for x in _TOKENS])
    hits = {k: T.matched(t, c) for k, c in (("標題命中：", F.col("title")), ("標籤接近：", F.array_join("tags", " ")), ("分類相關：", F.col("category")))}
    named = lambda label, h: F.when(F.size(h) > 0, F.concat(F.lit(label), F.array_join(F.slice(h, 1, 3), "、")))
    parts = [named(k, h) for k, h in hits.items()]
    summary = F.when(F.coalesce(*parts).isNull(), named("摘要語意接近：", T.matched(t, F.col("summary"))))
    profile = F.lit("命中使用者高頻分類：" + "、".join(_MATCH[0][:2])) if _MATCH[0] else F.lit(None)
    reasons = F.slice(F.filter(F.array(*parts, summary, profile), lambda x: x.isNotNull()), 1, 2)
    return items(spark, sf_dir).select("doc_id", F.when(F.size(reasons) > 0, F.array_join(reasons, "；")).otherwise("主題與當前對話高度相關").alias("reason"))
