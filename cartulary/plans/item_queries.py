"""Filters (P), identity and deduplication (D01-D03, W), joins (J) and set operations (U) over items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import predicates as P
from cartulary.operators.items import canonical_score, first_seen, fuzzy_lookup, identity, index_score, keep_best, mark_duplicates
from cartulary.operators.overlap import top_overlaps
from cartulary.plans.base import query
from cartulary.sources.records import items, messages, notes, table

_STATUS = r"(regexp_matches(trim(source_url), 'https?://(x|twitter)\.com/[^\s/]+/status/[0-9]{15,20}(\b|/|\?)') OR regexp_matches(trim(source_url), 'https?://x\.com/i/status/[0-9]{15,20}(\b|/|\?)'))"
_VALID = rf"(regexp_matches(trim(source_url), '^https?://') AND (NOT (contains(source_url, 'x.com') OR contains(source_url, 'twitter.com')) OR {_STATUS}))"
_LOW = "(trim(regexp_replace(regexp_replace(trim(summary), '^#+\\s*', ''), '^[-•]\\s*', '')) IN ('', '待整理', '待補充', '###'))"
_CLEAN_LEN = r"len(trim(regexp_replace(regexp_replace(regexp_replace(trim(summary), '^#+\s*', ''), '^[-•]\s*', ''), '\s+', ' ', 'g')))"


@query("SELECT id, (coalesce(lower(sensitivity), 'private') = 'public') OR coalesce(namespace = 'team-a', false) AS for_team, (coalesce(lower(sensitivity), 'private') = 'public') OR coalesce(namespace = 'private', true) AS for_private FROM items", items=True)
def acl(spark, sf_dir):
    """Who may see an item."""
    s, n = F.col("sensitivity"), F.col("namespace")
    return items(spark, sf_dir).select("id", P.allowed(s, n, "team-a").alias("for_team"), P.allowed(s, n, "private").alias("for_private"))


@query(f"SELECT id, source_url, {_VALID} AS valid FROM items", items=True)
def valid_urls(spark, sf_dir):
    """P02."""
    return items(spark, sf_dir).select("id", "source_url", P.valid_source_url(F.col("source_url")).alias("valid"))


@query(
    f"""SELECT id, array_to_string(list_filter([CASE WHEN source_url <> '' AND NOT {_VALID} THEN 'invalid_source_url' END,
  CASE WHEN regexp_matches(title, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-') AND {_LOW} THEN 'date_slug_low_signal' END,
  CASE WHEN regexp_matches(trim(title), '^[0-9]{{15,20}}$') AND {_LOW} THEN 'numeric_title_low_signal' END,
  CASE WHEN regexp_matches(lower(trim(title)), '^tweet\\s+[0-9]{{15,20}}$') AND {_LOW} THEN 'tweet_numeric_low_signal' END], lambda x: x IS NOT NULL), ',') AS reasons FROM items""",
    items=True,
)
def exclusion_reasons(spark, sf_dir):
    """P04, U09."""
    return items(spark, sf_dir).select("id", P.exclusion_reasons(F.col("title"), F.col("summary"), F.col("source_url")).alias("r")).select("id", F.array_join("r", ",").alias("reasons"))


ISSUES = f"""list_filter([CASE WHEN trim(title) = '' THEN 'missing_title' WHEN regexp_matches(trim(title), '^[0-9]{{15,20}}$') THEN 'numeric_title'
    WHEN regexp_matches(lower(trim(title)), '^tweet\\s+[0-9]{{15,20}}$') THEN 'tweet_numeric_title' WHEN regexp_matches(trim(title), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}-') AND len(trim(title)) < 42 THEN 'date_slug_title'
    WHEN len(trim(title)) < 8 THEN 'very_short_title' END,
  CASE WHEN {_LOW} THEN 'low_signal_summary' WHEN {_CLEAN_LEN} < 18 THEN 'very_short_summary' END,
  CASE WHEN source_url = '' THEN 'missing_source_url' WHEN NOT {_VALID} THEN 'invalid_source_url' END,
  CASE WHEN contains(path, '/legacy-') THEN 'legacy_card' END, CASE WHEN excluded THEN 'excluded' END], lambda x: x IS NOT NULL)"""


def audited(spark, sf_dir):
    c = F.col
    return items(spark, sf_dir).withColumn("issues", P.item_issues(c("title"), c("summary"), c("source_url"), c("path"), c("excluded"), F.lit(None).cast("string")))


@query(f"SELECT id, array_to_string({ISSUES}, ',') AS issues FROM items", items=True)
def item_audit(spark, sf_dir):
    """P05."""
    return audited(spark, sf_dir).select("id", F.array_join("issues", ",").alias("issues"))


@query(f"SELECT issue, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest({ISSUES}) AS issue FROM items) GROUP BY issue", items=True)
def audit_histogram(spark, sf_dir):
    """A01."""
    return audited(spark, sf_dir).select("id", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(
    f"""SELECT id, excluded OR ({_LOW} AND source_url = '') OR regexp_matches(trim(title), '^[0-9]{{15,20}}$') OR (regexp_matches(lower(trim(title)), '^tweet\\s+[0-9]{{15,20}}$') AND {_LOW})
  OR (category IN ('', 'general', 'misc', 'inbox', 'uncategorized') AND {_LOW}) AS hidden FROM items""",
    items=True,
)
def hidden_results(spark, sf_dir):
    """P03."""
    c = F.col
    return items(spark, sf_dir).select("id", P.hidden_result(c("title"), c("summary"), c("category"), c("excluded"), c("source_url")).alias("hidden"))


def _any(of: str, marks: tuple[str, ...], low: bool = False) -> str:
    x = f"lower({of})" if low else of
    return "(" + " OR ".join(f"contains({x}, '{m.replace(chr(39), chr(39) * 2)}')" for m in marks) + ")"


def _number(of: str, marks: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({of}, '{m.replace(chr(39), chr(39) * 2)}')::INT" for m in marks) + ")"


#: Pages and exports, some of them with what stands on pages without an article, some with their titles alone.
_EXPORTS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Log in to X ' || html WHEN 1 THEN 'Create account Trending now ' || html WHEN 2 THEN '---' || chr(10) || 'a: Sign in to X' || chr(10) || '---' || html WHEN 3 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE html END AS text FROM pages"


@query(f"SELECT page_id, {_any('body', P.JUNK)} AS junk, {_number('text', P.BAD_EXPORT)} >= 2 OR len(trim(text)) < 80 AS low_value, {_any('text', P.BAD_EXPORT)} AS bad_export FROM (SELECT *, CASE WHEN starts_with(text, '---') THEN regexp_replace(text, '\\A---(?s:.*?)---', '') ELSE text END AS body FROM ({_EXPORTS}))".replace("\\\\", "\\"))
def junk_pages(spark, sf_dir):
    """P06, P07, P31."""
    rows = spark.sql(_EXPORTS.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    t = F.col("text")
    return rows.select("page_id", P.is_junk_page(t).alias("junk"), P.is_low_value(t).alias("low_value"), P.is_bad_export(t).alias("bad_export"))


_ACK = "(len(trim(message)) <= 4 AND lower(trim(message)) IN (" + ", ".join(f"'{a}'" for a in P.ACKNOWLEDGEMENTS) + "))"
_SKIP = f"CASE WHEN {_ACK} THEN 'acknowledgement' WHEN regexp_matches(message, '(?i){'|'.join(P.GREETINGS)}') THEN 'greeting' ELSE '' END"
_INFO = "(len(lower(trim(message))) + 2 * len(regexp_extract_all(lower(trim(message)), '[一-鿿]')))"
_OFF = f"({_ACK} OR ({_INFO} <= 8 AND NOT {_any('trim(message)', P.DOMAINS, low=True)}) OR regexp_matches(message, '(?i){'|'.join(P.SUPPRESS)}'))"


@query(f"SELECT conv_id, turn, {_any('message', P.NOISE, low=True)} AS noise, {_SKIP} AS skip, {_OFF} AS suppressed FROM messages", views=("messages",))
def message_gates(spark, sf_dir):
    """P08, P15, P17."""
    t = F.col("message")
    return messages(spark, sf_dir).select("conv_id", "turn", P.is_noise(t).alias("noise"), P.skip_reason(t).alias("skip"), P.suppressed(t).alias("suppressed"))


_INTENT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(message, '(?i){p}') THEN '{n}' END" for n, p in P.INTENTS.items()) + "], lambda x: x IS NOT NULL), ',')"
_BOOST = "CASE conv_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 ELSE 0.0 END::DOUBLE"


@query(
    f"""SELECT conv_id, turn, intents, CASE WHEN trim(message) = '' THEN 'empty_input' WHEN (len(trim(message)) <= 8 AND lower(trim(message)) IN ('ok', '好', '收到', '謝謝', 'thanks')) OR regexp_matches(message, '{P.NEGATIVE}') THEN 'casual_or_ack'
  WHEN intents <> '' OR boost >= 0.35 THEN array_to_string(list_filter([CASE WHEN intents <> '' THEN 'intent:' || intents END, CASE WHEN boost >= 0.35 THEN 'topic_boost:' || boost END], lambda x: x IS NOT NULL), ';') ELSE 'no_trigger' END AS reason
  FROM (SELECT *, {_INTENT} AS intents, {_BOOST} AS boost FROM messages)""",
    views=("messages",),
)
def message_intents(spark, sf_dir):
    """Intents, negative cases, and whether recall runs, for every message. The topic boost is made up from the conversation's number."""
    t = F.col("message")
    rows = messages(spark, sf_dir).withColumn("boost", F.expr("CASE conv_id % 3 WHEN 0 THEN 0.5D WHEN 1 THEN 0.1D ELSE 0.0D END"))
    return rows.select("conv_id", "turn", F.array_join(P.intents(t), ",").alias("intents"), P.recall_gate(t, F.col("boost")).alias("reason"))


@query(
    r"""SELECT path, starts_with(name, '.') OR name IN ('INDEX.md', 'README.md') OR regexp_matches(name, 'search_index|vector_index|\.bak$') OR contains(path, 'notebooklm_exports/') AS skipped, regexp_matches(lower(trim(head)), '^(tweet\s+)?[0-9]{15,20}$') AS needs_title,
  lower(trim(head)) IN ('', '待整理', '待補充', 'tbd', 'todo', 'n/a', 'untitled', '(untitled)') AS placeholder, starts_with(left(body, 200), '---') AND NOT contains(left(body, 200), 'Redirect:') AS absorbable
  FROM (SELECT CASE doc_id % 6 WHEN 0 THEN 'memory/INDEX.md' WHEN 1 THEN path || '.bak' WHEN 2 THEN 'notebooklm_exports/' || stem || '.md' ELSE path END AS path, CASE doc_id % 6 WHEN 0 THEN 'INDEX.md' WHEN 1 THEN stem || '.md.bak' ELSE stem || '.md' END AS name,
    CASE doc_id % 4 WHEN 0 THEN 'TODO ' WHEN 1 THEN 'tweet 123456789012345678' ELSE head END AS head, CASE WHEN doc_id % 11 = 0 THEN replace(body, 'type: x-knowledge-card', 'Redirect: other') ELSE body END AS body FROM notes)""",
    views=("notes",),
)
def file_gates(spark, sf_dir):
    """Which files a queue passes over, which titles want another, which texts are placeholders, which topics absorb."""
    n = notes(spark, sf_dir).selectExpr(
        "CASE doc_id % 6 WHEN 0 THEN 'memory/INDEX.md' WHEN 1 THEN path || '.bak' WHEN 2 THEN 'notebooklm_exports/' || stem || '.md' ELSE path END AS path",
        "CASE doc_id % 4 WHEN 0 THEN 'TODO ' WHEN 1 THEN 'tweet 123456789012345678' ELSE head END AS head",
        "CASE WHEN doc_id % 11 = 0 THEN replace(body, 'type: x-knowledge-card', 'Redirect: other') ELSE body END AS body",
    )
    return n.select("path", P.skipped_path(F.col("path")).alias("skipped"), P.needs_title(F.col("head")).alias("needs_title"), P.is_placeholder(F.col("head")).alias("placeholder"), P.absorbable(F.col("body")).alias("absorbable"))


@query(
    r"""SELECT path, regexp_matches(body, '\A\s*(<think>(?s:.*?)</think>)?\s*---') AND contains(body, 'type: x-knowledge-card') AND kind IN ('x-bookmark', 'youtube', 'github_fork', 'github_star', 'local-paper', 'pubmed') AND regexp_matches(url, '^https?://[^\s/]+')
    AND NOT (kind = 'x-bookmark' AND NOT regexp_matches(url, '/(status|i/status)/[0-9]{15,20}')) AND NOT (lower(trim(head)) IN ('', '待整理', '待補充', 'tbd', 'todo', 'n/a', 'untitled', '(untitled)') AND doc_id % 2 = 0) AS valid, len(head) > 5 AND lang <> '' AS in_graph
  FROM (SELECT *, CASE WHEN contains(body, 'source_type: ') THEN CASE doc_id % 3 WHEN 1 THEN 'youtube' ELSE 'x-bookmark' END ELSE '' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'https://x.com/i/status/123456789012345678' ELSE 'https://example.org/' || doc_id END AS url FROM notes)""",
    views=("notes",),
)
def orphan_cards(spark, sf_dir):
    """Cards that may get an index row, and items that a graph takes."""
    n = notes(spark, sf_dir).selectExpr("*", "replace(body, 'source_type: card', 'source_type: ' || CASE doc_id % 3 WHEN 1 THEN 'youtube' ELSE 'x-bookmark' END) AS b", "CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'https://x.com/i/status/123456789012345678' ELSE 'https://example.org/' || doc_id END AS url", "CASE WHEN doc_id % 2 = 0 THEN 'TBD' ELSE 'said' END AS summary")
    return n.select("path", P.valid_orphan(F.col("b"), F.col("stem"), F.col("url"), F.col("head"), F.col("summary")).alias("valid"), P.graph_eligible(F.col("head"), F.col("summary"), F.col("lang")).alias("in_graph"))


@query("SELECT event_id, CASE WHEN given IS NULL THEN 10 WHEN regexp_matches(given, '^-?[0-9]+$') AND TRY_CAST(given AS BIGINT) BETWEEN 1 AND 50 THEN TRY_CAST(given AS BIGINT) END AS value, CASE WHEN given IS NULL THEN NULL WHEN NOT regexp_matches(given, '^-?[0-9]+$') THEN 'must be an integer' WHEN NOT (TRY_CAST(given AS BIGINT) BETWEEN 1 AND 50) THEN 'must be between 1 and 50' END AS error FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE json_extract_string(props, '$.k') END AS given FROM events)")
def bounded_limits(spark, sf_dir):
    """Limits as they come in requests: whole numbers within bounds; no booleans, fractions or text."""
    e = table(spark, sf_dir, "events").withColumn("given", F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN '1.5' ELSE get_json_object(props, '$.k') END"))
    return e.select("event_id", P.bounded(F.col("given"), 1, 50, 10).alias("b")).select("event_id", "b.value", "b.error")


_IDENT = r"""CASE WHEN regexp_matches(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', ''), '^[0-9]{15,20}$') THEN 'x:' || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')
  WHEN source_url <> '' AND regexp_extract(source_url, '/(?:status|i/status)/([0-9]{15,20})', 1) <> '' THEN 'x:' || regexp_extract(source_url, '/(?:status|i/status)/([0-9]{15,20})', 1)
  WHEN source_url <> '' THEN 'url:' || source_url ELSE 'id:' || id END"""


def identified(spark, sf_dir):
    return items(spark, sf_dir).withColumn("ident", identity(F.col("path"), F.col("source_url"), F.col("id")))


@query(f"SELECT id, {_IDENT} AS ident FROM items", items=True)
def record_identity(spark, sf_dir):
    """D01, D02, D04, D05."""
    return identified(spark, sf_dir).select("id", "ident")


_SCORE = r"""excluded, enriched DESC, (path LIKE 'memory/cards/%') DESC, (len(trim(summary)) >= 18) DESC, (NOT regexp_matches(lower(trim(title)), '^(tweet\s+)?[0-9]{15,20}$')) DESC,
  least(len(trim(summary)), 300) DESC, least(len(trim(title)), 120) DESC, mtime DESC, doc_id"""


@query(f"SELECT ident, id, group_size FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY {_SCORE}) AS r, count(*) OVER (PARTITION BY ident) AS group_size FROM (SELECT *, {_IDENT} AS ident FROM items)) WHERE r = 1", items=True)
def keep_best_records(spark, sf_dir):
    """The best row of each identity."""
    return keep_best(identified(spark, sf_dir), F.col("ident"), index_score(), "doc_id").select("ident", "id", "group_size")


@query(
    f"""SELECT id, source_url, dup_rank, CASE WHEN dup_rank > 1 THEN first_value(path) OVER (PARTITION BY source_url ORDER BY dup_rank) END AS duplicate_of FROM (
  SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY excluded, enriched DESC, (path LIKE 'memory/cards/%') DESC, (NOT {_LOW} AND {_CLEAN_LEN} >= 18) DESC,
    (trim(title) <> '' AND NOT regexp_matches(lower(trim(title)), '^(tweet\\s+)?[0-9]{{15,20}}$')) DESC, (NOT contains(path, 'legacy-')) DESC, least({_CLEAN_LEN}, 300) DESC, least(len(trim(title)), 120) DESC, doc_id) AS dup_rank
  FROM items WHERE {_VALID})""",
    items=True,
)
def canonical_duplicates(spark, sf_dir):
    """W02."""
    return mark_duplicates(items(spark, sf_dir), "doc_id").select("id", "source_url", "dup_rank", "duplicate_of")


@query("SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY left(md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 12)) AS first FROM documents)")
def first_seen_duplicates(spark, sf_dir):
    """fingerprint's first row."""
    key = F.left(F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))), F.lit(12))
    return first_seen(table(spark, sf_dir, "documents").select("doc_id", "text"), key, "doc_id", "doc_id").select("doc_id", "first_id")


@query("SELECT date, prefix, id FROM (SELECT *, row_number() OVER (PARTITION BY date, prefix ORDER BY doc_id) AS r FROM (SELECT doc_id, id, left(searchable, 120) AS prefix, (mtime // 86400)::BIGINT AS date FROM items)) WHERE r = 1", items=True)
def insight_dedup(spark, sf_dir):
    """One insight for each date and 120-character start; W09, W12 by other keys."""
    rows = items(spark, sf_dir).select("doc_id", "id", F.left("searchable", F.lit(120)).alias("prefix"), F.floor(F.col("mtime") / 86400).cast("long").alias("date"))
    return rows.groupBy("date", "prefix").agg(F.min_by("id", "doc_id").alias("id"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def newest_snapshot(spark, sf_dir):
    """The newest event of each user (the first of equals)."""
    e = table(spark, sf_dir, "events")
    best = F.max_by(F.struct("event_id", "ts"), F.struct("ts", (-F.col("event_id")).alias("o")))
    return e.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.ts")


@query("SELECT category, id, rank FROM (SELECT category, id, doc_id, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rank FROM items) WHERE rank <= 25 ORDER BY rank, category LIMIT 50", items=True)
def balanced_sample(spark, sf_dir):
    """Round robin over categories, 25 each, 50 in all."""
    w = Window.partitionBy("category").orderBy("doc_id")
    rows = items(spark, sf_dir).select("category", "id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 25")
    return rows.orderBy("rank", "category").limit(50)


@query("SELECT user_id, event_id, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS start FROM events)")
def running_blocks(spark, sf_dir):
    """Block numbers, and a carried value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = (F.col("event_type") == "signup").cast("int")
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(start).over(w).alias("block"), F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


_MAP = "(VALUES ('en', 'writing'), ('en', 'tools'), ('de', 'sprache'), ('fr', 'langue')) m(category, topic)"
_TAGMAP = "(VALUES ('src3', 'third'), ('src4', 'fourth'), ('q1', 'ones')) t(tag, topic)"


@query(
    f"""SELECT i.id, m.topic FROM items i JOIN {_MAP} ON i.category = m.category WHERE NOT excluded AND title <> '' AND source_url <> ''
UNION ALL SELECT DISTINCT u.id, t.topic FROM (SELECT id, unnest(tags) AS tag FROM items i WHERE NOT excluded AND title <> '' AND source_url <> '' AND category NOT IN ('en', 'de', 'fr')) u JOIN {_TAGMAP} ON u.tag = t.tag""",
    items=True,
)
def mapped_cards(spark, sf_dir):
    """Cards to topics by category; by tag only where no category maps. The maps are configuration, a few rows."""
    by_cat = spark.sql(f"SELECT * FROM {_MAP}")
    by_tag = spark.sql(f"SELECT * FROM {_TAGMAP}")
    cards = items(spark, sf_dir).where("not excluded and title <> '' and source_url <> ''").select("id", "category", "tags")
    direct = cards.join(by_cat, "category").select("id", "topic")
    rest = cards.join(by_cat, "category", "left_anti").select("id", F.explode("tags").alias("tag")).join(by_tag, "tag").select("id", "topic").distinct()
    return direct.unionByName(rest)


@query("SELECT i.id, coalesce(d.target, i.category) AS topic, CASE WHEN d.kind = 'move' THEN 'moved' WHEN d.kind = 'skip' THEN 'skipped' WHEN d.kind = 'allow' THEN 'allowed' ELSE 'auto' END AS gate FROM items i LEFT JOIN (VALUES ('0', 'move', 'archive'), ('2', 'skip', NULL), ('3', 'allow', NULL)) d(id, kind, target) ON i.id = d.id", items=True)
def decision_routing(spark, sf_dir):
    """Manual decisions, move before skip before allow."""
    d = spark.sql("SELECT * FROM VALUES ('0', 'move', 'archive'), ('2', 'skip', NULL), ('3', 'allow', NULL) d(id, kind, target)")
    gate = F.when(F.col("kind") == "move", "moved").when(F.col("kind") == "skip", "skipped").when(F.col("kind") == "allow", "allowed").otherwise("auto")
    return items(spark, sf_dir).join(d, "id", "left").select("id", F.coalesce("target", "category").alias("topic"), gate.alias("gate"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled(spark, sf_dir):
    """Rows without a partner."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'gone' WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = 0 THEN 'changed' ELSE 'same' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def incremental_scan(spark, sf_dir):
    """A listing against the index: new, changed, same, gone."""
    now = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("here"))
    old = table(spark, sf_dir, "labels").select("doc_id", "quality")
    state = F.when(F.col("here").isNull(), "gone").when(F.col("quality").isNull(), "new").when(F.col("quality") == 0, "changed").otherwise("same")
    return now.join(old, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("SELECT c.conv_id, c.turn, f.n, f.roles FROM conversations c JOIN (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id) f ON c.conv_id = f.conv_id WHERE c.role = 'user'")
def turns_with_sessions(spark, sf_dir):
    """Turns with their sessions' totals."""
    c = table(spark, sf_dir, "conversations")
    f = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("roles"))
    return c.where("role = 'user'").join(f, "conv_id").select("conv_id", "turn", "n", "roles")


@query("SELECT a, b, shared FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared, row_number() OVER (PARTITION BY x.id ORDER BY count(*) DESC, y.id) AS r FROM (SELECT id, unnest(tags) AS tag FROM items WHERE doc_id % 100 = 0) x JOIN (SELECT id, unnest(tags) AS tag FROM items) y ON x.tag = y.tag AND x.id <> y.id GROUP BY x.id, y.id) WHERE r <= 3", items=True)
def related_by_tags(spark, sf_dir):
    """The three items that share most tags. A search: queries are the items whose id is divisible by 100."""
    t = items(spark, sf_dir)
    found = top_overlaps(t.where("doc_id % 100 = 0").select(F.col("id").alias("query"), F.col("tags").alias("elements")), t.select("id", F.col("tags").alias("elements")), 3)
    return found.select(F.col("query").alias("a"), F.col("id").alias("b"), F.col("shared").cast("long").alias("shared"))


_ASKED_KEYS = "SELECT doc_id AS k, CASE doc_id % 6 WHEN 0 THEN path WHEN 1 THEN substr(path, 8) WHEN 2 THEN substr(path, 8, length(path) - 10) WHEN 3 THEN path WHEN 4 THEN 'old/' || stem || '.md' ELSE 'none-' || stem END AS key FROM notes"
_KNOWN_KEYS = "SELECT CASE WHEN doc_id % 6 = 3 THEN path || '#kp' || (doc_id % 2) ELSE path END AS key FROM notes"


@query(
    f"""SELECT k, arg_min(step, (p, f)) AS step, arg_min(f, (p, f)) AS found FROM (SELECT a.k, a.key, s.p, s.step, n.key AS f FROM ({_ASKED_KEYS}) a JOIN (VALUES (1, 'exact'), (2, 'prefix'), (3, 'alternate'), (4, 'point'), (5, 'name')) s(p, step) ON true JOIN (SELECT key, split_part(key, '#', 1) AS base, regexp_extract(split_part(key, '#', 1), '([^/]*)$', 1) AS name, contains(key, '#') AS point FROM ({_KNOWN_KEYS})) n
  ON CASE s.p WHEN 1 THEN n.key = a.key WHEN 2 THEN n.key = regexp_replace(a.key, '^memory/', '') WHEN 3 THEN n.key IN ('memory/' || a.key, 'memory/' || a.key || '.md', a.key || '.md') WHEN 4 THEN n.point AND n.base = a.key ELSE n.name = regexp_extract(a.key, '([^/]*)$', 1) END) GROUP BY k""",
    views=("notes",),
)
def fuzzy_keys(spark, sf_dir):
    """A key as it is, without its prefix, in other forms, with a point's number, or by its file's name; the first that is known."""
    n = notes(spark, sf_dir)
    of = lambda sql: spark.sql(sql.replace("FROM notes", "FROM {n}"), n=n)
    return fuzzy_lookup(of(_ASKED_KEYS), of(_KNOWN_KEYS), "k")


_GOOD = "list_filter(list_concat(tags, ['x', '12', 'General', 'fine']), lambda t: len(t) >= 2 AND lower(t) NOT IN (" + ", ".join(f"'{t}'" for t in P.GENERIC_TAGS) + ") AND NOT regexp_matches(t, '^[0-9]+$'))"


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(tags, ['src1', 'zz']))), ',') AS joined, list_has_any(tags, ['en', 'src1']) AS touches, array_to_string(list_sort(list_filter(tags, lambda t: t NOT IN ('en', 'de'))), ',') AS rest, array_to_string({_GOOD}, ',') AS good FROM items", items=True)
def tag_sets(spark, sf_dir):
    """Unions, differences and overlaps of sets; tags that say something."""
    x = F.array(F.lit("src1"), F.lit("zz"))
    good = P.good_tags(F.concat("tags", F.array(*map(F.lit, ("x", "12", "General", "fine")))))
    return items(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_union("tags", x)), ",").alias("joined"), F.arrays_overlap("tags", F.array(F.lit("en"), F.lit("src1"))).alias("touches"), F.array_join(F.array_sort(F.array_except("tags", F.array(F.lit("en"), F.lit("de")))), ",").alias("rest"), F.array_join(good, ",").alias("good"))


@query("SELECT a AS id, '## Related' || chr(10) || string_agg('- [[' || b || ']]', chr(10) ORDER BY shared DESC, b) AS block FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared, row_number() OVER (PARTITION BY x.id ORDER BY count(*) DESC, y.id) AS r FROM (SELECT id, unnest(tags) AS tag FROM items WHERE doc_id % 100 = 0) x JOIN (SELECT id, unnest(tags) AS tag FROM items) y ON x.tag = y.tag AND x.id <> y.id GROUP BY x.id, y.id) WHERE r <= 3 GROUP BY a", items=True)
def cross_links(spark, sf_dir):
    """What is appended to a bookmark: links to its three nearest. A search, as related_by_tags."""
    r = related_by_tags(spark, sf_dir)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "b"))), lambda x: F.concat(F.lit("- [["), x.b, F.lit("]]")))
    return r.groupBy(F.col("a").alias("id")).agg(F.concat(F.lit("## Related\n"), F.array_join(lines, "\n")).alias("block"))
