"""Ranking and retrieval (T, U01-U02, R) over items, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.predicates import hidden_result
from cartulary.operators import ranking as R
from cartulary.operators import router as W
from cartulary.plans.base import query
from cartulary.plans.item_queries import _OFF
from cartulary.sources.records import items, messages, table

_TERMS = ["the", "tion"]


def _points(tokens, weights):
    fields = {"title": "lower(title)", "tags": "lower(array_to_string(tags, ' '))", "category": "lower(category)", "summary": "lower(summary)", "blob": "lower(searchable)"}
    return " + ".join(f"CASE WHEN contains({fields[f]}, '{t}') THEN {n} ELSE 0 END" for t in tokens for f, n in weights.items())


_CARD = _points(["the", "src1", "en"], {"title": 8, "tags": 6, "category": 4, "summary": 3, "blob": 1}) + " + CASE WHEN contains(lower(searchable), 'the src1 en') THEN 8 ELSE 0 END + CASE WHEN summary <> '' THEN 2 ELSE 0 END + 1"


def _cards(spark, sf_dir):
    return items(spark, sf_dir).withColumn("score", R.card_score(["the", "src1", "en"], "the src1 en"))


@query(f"SELECT doc_id, id, score FROM (SELECT doc_id, id, {_CARD} AS score FROM items) WHERE score >= 6 ORDER BY score DESC, doc_id LIMIT 10", items=True)
def keyword_card_topk(spark, sf_dir):
    """The ten best cards for a query."""
    return R.top(_cards(spark, sf_dir), 10, F.desc("score"), "doc_id").where("score >= 6").select("doc_id", "id", "score")


@query(f"SELECT doc_id, {_CARD} AS score FROM items", items=True)
def card_scores(spark, sf_dir):
    """R02 for every card."""
    return _cards(spark, sf_dir).select("doc_id", "score")


_AND = " AND ".join(f"contains(lower(searchable), '{t}')" for t in _TERMS)


@query(f"SELECT doc_id, {_points(_TERMS, {'title': 6, 'tags': 5, 'category': 3, 'summary': 2, 'blob': 1})} AS score FROM items WHERE {_AND} ORDER BY score DESC, doc_id LIMIT 30", items=True)
def and_search(spark, sf_dir):
    """All terms, the best thirty."""
    return R.top(items(spark, sf_dir).withColumn("score", R.search_score(_TERMS)).where("score is not null"), 30, F.desc("score"), "doc_id").select("doc_id", "score")


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(summary), '^#+\s*', ''), '^[-•]\s*', ''), '\s+', ' ', 'g'))"
_ADJUST = rf"""round((CASE WHEN {_CLEAN} = '' THEN -0.08 WHEN {_CLEAN} IN ('', '待整理', '待補充', '###') THEN -0.12 WHEN len({_CLEAN}) < 12 THEN -0.05 WHEN len({_CLEAN}) >= 40 THEN 0.05 ELSE 0.02 END
  + CASE WHEN trim(title) = '' THEN -0.12 WHEN regexp_matches(lower(trim(title)), '^tweet\s+[0-9]{{15,20}}$') THEN -0.14 WHEN regexp_matches(trim(title), '^[0-9]{{15,20}}$') THEN -0.16
    WHEN regexp_matches(trim(title), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-') AND len(trim(title)) < 42 THEN -0.08 WHEN len(trim(title)) < 8 THEN -0.05 ELSE 0.03 END
  + CASE WHEN source_type = 'youtube' THEN 0.05 ELSE 0 END + CASE WHEN starts_with(source_url, 'https://') THEN 0.05 ELSE 0 END + CASE WHEN contains(source_url, 'github.com') THEN 0.05 ELSE 0 END
  + CASE WHEN contains(source_url, 'x.com/') THEN 0.02 ELSE 0 END + CASE WHEN regexp_matches(trim(title), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-') THEN -0.08 ELSE 0 END
  + CASE WHEN category = 'general' THEN -0.08 ELSE 0 END)::DOUBLE, 4)"""


@query(f"SELECT doc_id, {_ADJUST} AS adjustment FROM items", items=True)
def ranking_adjustments(spark, sf_dir):
    """Summary, title, source, category and provenance."""
    return items(spark, sf_dir).select("doc_id", R.adjustments().alias("adjustment"))


@query(f"SELECT doc_id, round(({_CARD}) + 10 * {_ADJUST}, 4)::DOUBLE AS score FROM items WHERE ({_CARD}) + 10 * {_ADJUST} >= 6 AND NOT excluded AND NOT regexp_matches(trim(title), '^[0-9]{{15,20}}$') AND NOT ({_CLEAN} IN ('', '待整理') AND (source_url = '' OR category = 'general' OR regexp_matches(lower(trim(title)), '^tweet\\s+[0-9]{{15,20}}$'))) ORDER BY 2 DESC, 1 LIMIT 20", items=True)
def keyword_recall(spark, sf_dir):
    """Card score and adjustments, least score, hidden rows out."""
    c = F.col
    rows = _cards(spark, sf_dir).where(~hidden_result(c("title"), c("summary"), c("category"), c("excluded"), c("source_url")))
    rows = rows.select("doc_id", F.round(c("score") + 10 * R.adjustments(), 4).cast("double").alias("score"))
    return R.top(rows, 20, F.desc("score"), "doc_id").where("score >= 6")  # after the limit, so that the score is computed once


@query("SELECT event_id, round(CASE WHEN value <= 0 THEN 0 ELSE value / (value + a) END, 4)::DOUBLE AS relevance, round(CASE WHEN value <= 0 THEN 0 ELSE value / (value + a) * w END, 4)::DOUBLE AS unified_score FROM (SELECT event_id, value, CASE event_type WHEN 'click' THEN 0.88 WHEN 'view' THEN 0.93 ELSE 0.5 END::DOUBLE AS a, CASE event_type WHEN 'click' THEN 0.85 WHEN 'view' THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM events)")
def unified_scores(spark, sf_dir):
    """Scores of layers on one scale (clicks as cards, views as wiki, the rest unknown)."""
    layer = F.when(F.col("event_type") == "click", "card").when(F.col("event_type") == "view", "wiki").otherwise("other")
    rel, uni = R.unified(F.col("value"), layer)
    return table(spark, sf_dir, "events").select("event_id", rel.cast("double").alias("relevance"), uni.cast("double").alias("unified_score"))


@query("SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, count(*) AS lists FROM (SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 100 UNION ALL SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY len(replace(text, 'e', '')), doc_id) AS rank FROM documents) WHERE rank <= 100) GROUP BY doc_id")
def hybrid_fusion(spark, sf_dir):
    """Reciprocal rank fusion of two lists of a hundred."""
    d = table(spark, sf_dir, "documents").withColumn("m", F.length(F.replace("text", F.lit("e"), F.lit(""))))
    ranked = lambda *order: R.top(d, 100, *order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return R.rank_fusion([ranked(F.desc("n_chars"), "doc_id"), ranked("m", "doc_id")], "doc_id")


@query("SELECT conv_id, turn, round(0.65 * ((contains(lower(text), 'the')::INT + contains(lower(text), 'zz')::INT) / 2.0), 4)::DOUBLE AS score FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 500) WHERE contains(lower(text), 'the') OR contains(lower(text), 'zz') ORDER BY 3 DESC, 1 DESC, 2 DESC LIMIT 20")
def conversation_recall(spark, sf_dir):
    """The share of terms in the latest 500 turns, discounted. (Both limits are the operator's.)"""
    latest = R.top(table(spark, sf_dir, "conversations"), 500, F.desc("conv_id"), F.desc("turn"))
    hits = F.contains(F.lower("text"), F.lit("the")).cast("int") + F.contains(F.lower("text"), F.lit("zz")).cast("int")
    return R.top(latest.where(hits > 0).select("conv_id", "turn", F.round(0.65 * (hits / 2.0), 4).cast("double").alias("score")), 20, F.desc("score"), F.desc("conv_id"), F.desc("turn"))


@query("SELECT doc_id, round(0.6 * rel + 0.4 * least(sig / 5.0, 1), 4)::DOUBLE AS score FROM (SELECT doc_id, len(regexp_extract_all(text, '(?i)(and|that|der)')) AS sig, (contains(lower(text), 'the')::INT + contains(lower(text), 'scum')::INT) / 2.0 AS rel FROM documents) WHERE sig > 0 AND rel >= 0.15 ORDER BY score DESC, doc_id LIMIT 50")
def contrarian_recall(spark, sf_dir):
    """Texts with signal words, by relevance and signals."""
    words = F.array(F.lit("the"), F.lit("scum"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit("(?i)(and|that|der)")).alias("sig"), T.hit_fraction(words, F.col("text")).alias("rel"))
    return R.top(d.where("sig > 0 and rel >= 0.15").select("doc_id", F.round(0.6 * F.col("rel") + 0.4 * F.least(F.col("sig") / 5.0, F.lit(1)), 4).cast("double").alias("score")), 50, F.desc("score"), "doc_id")


@query("SELECT 'document' AS kind, doc_id AS id, n_chars AS weight FROM documents UNION ALL SELECT 'page', page_id, len(html) FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, len(text) FROM conversations")
def layer_union(spark, sf_dir):
    """Layers as one table."""
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("n_chars").alias("weight"))
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.length("html").cast("long").alias("weight"))
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("weight"))
    return d.unionByName(p).unionByName(c)


@query("SELECT doc_id, round(2.0 * n_the + least(2.5, 0.5 * n_of) + ln(1 + n_chars), 4)::DOUBLE AS score FROM (SELECT doc_id, n_chars, least(3, len(regexp_extract_all(lower(text), 'the'))) AS n_the, len(regexp_extract_all(lower(text), ' of ')) AS n_of FROM documents) ORDER BY 2 DESC, 1 LIMIT 12")
def recommendations(spark, sf_dir):
    """Keyword hits by the profile's weight, a bounded overlap bonus, engagement; the best twelve."""
    t = F.lower("text")
    score = 2.0 * F.least(F.lit(3), F.regexp_count(t, F.lit("the"))) + F.least(F.lit(2.5), 0.5 * F.regexp_count(t, F.lit(" of "))) + F.log1p("n_chars")
    return R.top(table(spark, sf_dir, "documents").select("doc_id", F.round(score, 4).alias("score")), 12, F.desc("score"), "doc_id")


@query("SELECT i.id, m.category AS matched, round(m.weight, 4)::DOUBLE AS boost FROM items i JOIN (SELECT category, count(*)::DOUBLE / max(count(*)) OVER () AS weight FROM items GROUP BY category) m ON i.category = m.category WHERE m.weight >= 0.2", items=True)
def profile_boost(spark, sf_dir):
    """The weight of an item's category in the profile."""
    i = items(spark, sf_dir)
    counts = i.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    weight = counts.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy()))
    return i.join(weight.where("weight >= 0.2"), "category").select("id", F.col("category").alias("matched"), F.round("weight", 4).alias("boost"))


def _hit_list(patterns: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(message, '(?i){p}') THEN '{p[:40]}' END" for p in patterns) + "], lambda x: x IS NOT NULL)"


_ROUTED = f"""SELECT *, CASE WHEN trigger = 'suppress' THEN 0.95 WHEN trigger = 'hard' THEN least(0.6 + 0.1 * len(hard), 0.95) WHEN len(soft) > 0 THEN least(0.5 + 0.08 * len(soft), 0.9) ELSE 0.3 END::DOUBLE AS c FROM (
  SELECT *, CASE WHEN off THEN 'suppress' WHEN len(hard) > 0 THEN 'hard' ELSE 'soft' END AS trigger FROM (SELECT conv_id, turn, message, {_OFF} AS off, {_hit_list(W.named(W.HARD))} AS hard, {_hit_list(W.named(W.SOFT))} AS soft FROM messages))"""


@query(
    f"""SELECT conv_id, turn, trigger, CASE trigger WHEN 'suppress' THEN 'suppress' WHEN 'hard' THEN 'continuity' ELSE 'brainstorming' END AS state, round(c, 4) AS confidence, CASE WHEN trigger = 'suppress' THEN 'suppress' WHEN trigger = 'hard' THEN array_to_string(hard[1:3], ' ') WHEN len(soft) > 0 THEN array_to_string(soft[1:3], ' ') ELSE 'default_light_scan' END AS rules,
  CASE WHEN trigger = 'suppress' THEN '' WHEN trigger = 'hard' THEN 'memory,wiki,card,action' ELSE array_to_string(list_filter(['wiki', CASE WHEN c >= 0.4 THEN 'card' END, CASE WHEN c >= 0.55 THEN 'contrarian' END], lambda x: x IS NOT NULL), ',') END AS layers,
  CASE WHEN trigger = 'suppress' THEN 'none' WHEN trigger = 'hard' THEN CASE WHEN conv_id % 4 > 0 THEN 'inline_injection' ELSE 'none' END WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 'none' WHEN conv_id % 3 >= 2 OR (conv_id % 3 = 0 AND c >= 0.6) THEN 'side_hint' ELSE 'expandable_hint' END AS mode,
  CASE WHEN trigger = 'suppress' THEN '' WHEN regexp_matches(message, '[一-鿿]') THEN left(trim(message), 60) END AS cjk_query FROM ({_ROUTED})""",
    views=("messages",),
)
def message_triggers(spark, sf_dir):
    """Of every message the class, state, confidence, rules, layers, and how results would reach it (their numbers are made up from those of the turn)."""
    rows = W.route(messages(spark, sf_dir), "message")
    c = F.col
    mode = W.delivery(c("trigger"), c("confidence"), c("conv_id") % 4, (c("conv_id") % 3).cast("double"), c("turn") % 2, F.lit(0))
    cjk = F.when(c("trigger") == "suppress", "").when(c("message").rlike("[一-鿿]"), c("suggested_query"))
    return rows.select("conv_id", "turn", "trigger", "state", "confidence", F.array_join("rules", " ").alias("rules"), F.array_join("layers", ",").alias("layers"), mode.alias("mode"), cjk.alias("cjk_query"))


@query(
    f"SELECT day, trigger, count(*) AS n, count(*) FILTER (c >= 0.4) AS recalled FROM (SELECT *, conv_id % 7 AS day FROM ({_ROUTED})) GROUP BY ALL",
    views=("messages",),
)
def recall_telemetry(spark, sf_dir):
    """What recall did, counted by day and class (days are made up from the conversation's number)."""
    rows = W.route(messages(spark, sf_dir), "message").withColumn("day", F.col("conv_id") % 7)
    return rows.groupBy("day", "trigger").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.4).alias("recalled"))
