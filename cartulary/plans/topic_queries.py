"""Topic pages, staging, stores and reports over pages, conversations and items (S07-S12, S42, S49, K01-K19, P28, D33, D46, D54, F18, F32, J03, J15, J16, A02-A06, A17-A30, M11, M18, U06, W12, I14, I15, T01)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.operators import notes as N
from cartulary.operators import topics as P
from cartulary.plans.base import query
from cartulary.plans.note_queries import _ROWS
from cartulary.sources import store
from cartulary.sources.records import items, notes, table

#: Topic pages, one for each web page: some redirect, some have no date or no sources. Valid in both.
_PAGES = """SELECT page_id, 'topic-' || page_id AS slug, CASE WHEN page_id % 13 = 0 THEN 'Redirect: topic-1' || nl ELSE '---' || nl || 'title: T' || page_id || nl || 'tags: [a, b]' || nl || CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'last_updated: soon' || nl ELSE 'last_updated: 2024-0' || (1 + page_id % 6) || '-1' || (page_id % 9) || nl END
  || 'sources: ' || (page_id % 4) || nl || 'status: active' || nl || 'zeta: x' || nl || '---' || nl || nl || '# T' || page_id || nl || nl || '## 核心概念' || nl || nl || CASE WHEN page_id % 3 > 0 THEN '- one *(self-derived · memory/2024-01-05.md)*' || nl ELSE '' END || '- two' || nl || nl || '## TODO' || nl || 'later' || nl
  || CASE WHEN page_id % 11 = 0 THEN '' ELSE nl || '## 來源' || nl || CASE WHEN page_id % 4 > 0 THEN '- [a](https://example.org/p/' || (page_id % 97) || ') — 2024-01-01' || nl ELSE '' END || CASE WHEN page_id % 4 > 1 THEN '- [b](https://github.com/en/' || (page_id % 50) || ') — 2024-01-02' || nl ELSE '' END END END AS body FROM (SELECT page_id, chr(10) AS nl FROM pages)"""
_CARDS = "SELECT 'topic-' || (doc_id % 250) AS slug, source_url AS url, title, left('2024-01-' || lpad('' || (1 + doc_id % 28), 2, '0'), 10) AS date FROM items WHERE starts_with(source_url, 'https://example') OR starts_with(source_url, 'https://github')"


def _pages(spark, sf_dir):
    return spark.sql(_PAGES.replace("FROM pages", "FROM {p}"), p=table(spark, sf_dir, "pages"))


def _cards(spark, sf_dir):
    return spark.sql(_CARDS.replace("FROM items", "FROM {i}").replace("starts_with", "startswith"), i=items(spark, sf_dir))


_URLS = r"list_distinct(regexp_extract_all(regexp_extract(body, '(?s)\n## 來源\n(.*)', 1), '\((https?://[^)]+)\)', 1))"


@query(f"SELECT slug, unnest({_URLS}) AS url FROM ({_PAGES})")
def topic_sources(spark, sf_dir):
    """The addresses that pages list."""
    return _pages(spark, sf_dir).select("slug", F.explode(P.source_urls(F.col("body"))).alias("url"))


_NEW = f"SELECT c.slug, c.url, max((date, title)) AS b FROM ({_CARDS}) c JOIN (SELECT slug FROM ({_PAGES})) p ON c.slug = p.slug WHERE NOT EXISTS (SELECT 1 FROM (SELECT slug, unnest({_URLS}) AS url FROM ({_PAGES})) k WHERE k.slug = c.slug AND k.url = c.url) GROUP BY 1, 2"


@query(f"SELECT slug, url, struct_extract_at(b, 2) AS title, struct_extract_at(b, 1) AS date FROM ({_NEW})", items=True)
def new_topic_sources(spark, sf_dir):
    """Cards whose address their page does not list, the newest of each address."""
    return P.new_sources(_pages(spark, sf_dir), _cards(spark, sf_dir)).select("slug", "url", "title", "date")


@query(
    rf"""SELECT p.slug, n.added, md5(CASE WHEN NOT starts_with(body, '---') OR contains(left(body, 200), 'Redirect:') OR NOT contains(body, chr(10) || '## 來源' || chr(10)) THEN body ELSE regexp_replace(regexp_replace(split_part(body, chr(10) || '## 來源' || chr(10), 1), '(?m)^sources:.*$', 'sources: ' || (known + n.added)), '(?m)^last_updated:.*$', 'last_updated: 2024-07-01')
  || chr(10) || '## 來源' || chr(10) || rtrim(split_part(body, chr(10) || '## 來源' || chr(10), 2), chr(10)) || chr(10) || n.lines || chr(10) END) AS body FROM (SELECT *, len({_URLS}) AS known FROM ({_PAGES})) p
  JOIN (SELECT slug, count(*) AS added, string_agg('- [' || struct_extract_at(b, 2) || '](' || url || ') — ' || struct_extract_at(b, 1), chr(10) ORDER BY url) AS lines FROM ({_NEW}) GROUP BY slug) n ON p.slug = n.slug""",
    items=True,
)
def topic_updates(spark, sf_dir):
    """Pages with their new sources appended, and the number and day in their front matter."""
    pages = _pages(spark, sf_dir)
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(") — "), F.col("date"))
    new = P.new_sources(pages, _cards(spark, sf_dir)).groupBy("slug").agg(F.count(F.lit(1)).alias("added"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    out = pages.join(new, "slug")
    body = P.with_sources(F.col("body"), F.col("lines"), F.size(P.source_urls(F.col("body"))) + F.col("added"), F.lit("2024-07-01"))
    return out.select("slug", "added", F.md5(body).alias("body"))


_FIELD = lambda k: rf"trim(regexp_extract(body, '(?m)^{k}:[ \t]*(.*)$', 1))"


@query(f"SELECT slug, '- [' || {_FIELD('title')} || '](topics/' || slug || '.md) — | status: ' || {_FIELD('status')} || ' | sources: ' || {_FIELD('sources')} || ' | last_updated: ' || coalesce(nullif({_FIELD('last_updated')}, ''), 'unknown') AS line FROM ({_PAGES}) WHERE starts_with(body, '---')")
def topic_registry(spark, sf_dir):
    """The registry's lines."""
    return _pages(spark, sf_dir).select("slug", P.registry_line(F.col("slug"), F.col("body")).alias("line")).where("line is not null")


@query(f"SELECT slug FROM ({_PAGES}) WHERE NOT (starts_with(body, '---') AND page_id % 3 <> 0)")
def orphan_topics(spark, sf_dir):
    """Pages that the registry (here that of two pages in three) does not list."""
    pages = _pages(spark, sf_dir)
    listed = pages.where("page_id % 3 <> 0").select("slug", P.registry_line(F.col("slug"), F.col("body")).alias("line")).where("line is not null")
    return pages.join(listed, "slug", "left_anti").select("slug")


@query(
    rf"""SELECT slug, days, CASE WHEN d = '' THEN 'no last_updated' WHEN days IS NULL THEN 'unparseable date: ' || d WHEN days > 60 THEN days || ' days ago' END AS stale, len(regexp_extract_all(body, '(?m)^\s*- \[')) AS source_lines, entries, conversation, entries - conversation AS external, len(regexp_extract_all(body, '(?m)^## .+')) AS sections FROM (
  SELECT *, datediff('day', TRY_CAST(d AS DATE), DATE '2024-06-30') AS days, len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '- ') AND len(x) > 2)) AS entries, len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '- ') AND regexp_matches(x, '\*\([^)]*memory/[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))) AS conversation FROM (SELECT *, {_FIELD('last_updated')} AS d FROM ({_PAGES})))"""
)
def topic_health(spark, sf_dir):
    """Age, staleness, sources, entries by origin and sections of pages."""
    out = P.page_health(_pages(spark, sf_dir), F.lit("2024-06-30").cast("date"))
    return out.select("slug", *[F.col(c).cast("long").alias(c) for c in ("days", "source_lines", "entries", "conversation", "external", "sections")], "stale")


@query(
    rf"""SELECT slug, md5(regexp_replace(CASE WHEN contains(body, '## ' || s) THEN left(body, strpos(body, '## ' || s) - 1) || '## ' || s || chr(10) || chr(10) || e || substr(body, strpos(body, '## ' || s) + len('## ' || s)) ELSE rtrim(body, chr(10)) || chr(10) || chr(10) || '## ' || s || chr(10) || chr(10) || e || chr(10) END, 'last_updated:\s*\S+', 'last_updated: 2024-07-01')) AS body
  FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN '核心概念' ELSE '案例' END AS s, '- entry ' || page_id || ' *(self-derived · memory/2024-02-02.md)*' AS e FROM ({_PAGES}))"""
)
def topic_entries(spark, sf_dir):
    """An entry at the head of a section, or in a new one; marked as self-derived."""
    section = F.when(F.col("page_id") % 2 == 0, "核心概念").otherwise("案例")
    entry = F.concat(F.lit("entry "), F.col("page_id").cast("string"))
    return _pages(spark, sf_dir).select("slug", F.md5(P.with_entry(F.col("body"), section, entry, F.lit("2024-02-02"), F.lit("2024-07-01"))).alias("body"))


@query(rf"SELECT slug, md5(regexp_replace(body, '## TODO\n[^#]*', '')) AS body FROM ({_PAGES})")
def public_topics(spark, sf_dir):
    """Pages without the sections about themselves."""
    return _pages(spark, sf_dir).select("slug", F.md5(P.without_internal(F.col("body"))).alias("body"))


_STAGED = """SELECT conv_id, turn, '- **Topic:** ' || CASE conv_id % 4 WHEN 0 THEN '[NEW: x]' ELSE 'topic-' || (conv_id % 20) END || nl || CASE WHEN turn % 2 = 0 THEN '- **Section:** Cases' || nl ELSE '' END || CASE WHEN conv_id % 3 = 0 THEN '- **Confidence:** high' || nl ELSE '' END || CASE WHEN turn % 3 = 0 THEN '' ELSE '- **Source date:** 2024-01-1' || (turn % 9) || nl END
  || '- **Status:** ' || CASE (conv_id + turn) % 3 WHEN 0 THEN '[x] approve  [ ] skip' WHEN 1 THEN '[ ] approve  [x] skip' ELSE '[ ] approve  [ ] skip' END || nl || nl || CASE WHEN turn % 5 = 4 THEN '' ELSE replace(text, nl, ' ') || nl END || '---' AS block FROM (SELECT conv_id, turn, text, chr(10) AS nl FROM conversations)"""
_SF = "SELECT conv_id, turn, block, CASE conv_id % 4 WHEN 0 THEN '[NEW: x]' ELSE 'topic-' || (conv_id % 20) END AS topic, CASE WHEN turn % 2 = 0 THEN 'Cases' ELSE '核心概念' END AS section, CASE WHEN conv_id % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE '2024-01-1' || (turn % 9) END AS source_date, CASE (conv_id + turn) % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN turn % 5 = 4 THEN '' ELSE trim(replace(text, chr(10), ' ')) END AS said FROM conversations JOIN (" + _STAGED + ") USING (conv_id, turn)"


def _staged(spark, sf_dir):
    rows = spark.sql(_STAGED.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))
    return rows.withColumn("c", P.staged(F.col("block")))


@query(f"SELECT conv_id, turn, topic, section, confidence, source_date, status, md5(said) AS said, (status = 'approved' OR confidence = 'high') AND said <> '' AND conv_id % 4 <> 0 AS applied FROM ({_SF})")
def staged_candidates(spark, sf_dir):
    """The fields of staged candidates, and which are applied where those of high confidence need no review."""
    s = _staged(spark, sf_dir)
    return s.select("conv_id", "turn", "c.topic", "c.section", "c.confidence", "c.source_date", "c.status", F.md5("c.text").alias("said"), P.approved(F.col("c"), high=True).alias("applied"))


@query(f"SELECT status, count(*) AS n, count(*) FILTER (confidence = 'high') AS high, count(DISTINCT topic) AS topics, min(source_date) FILTER (source_date <> 'unknown') AS first_date, max(source_date) FILTER (source_date <> 'unknown') AS last_date FROM ({_SF}) GROUP BY status")
def staging_stats(spark, sf_dir):
    """Staged candidates by status: their confidence, topics and dates."""
    s = _staged(spark, sf_dir).select("c.*")
    day = F.when(F.col("source_date") != "unknown", F.col("source_date"))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.countDistinct("topic").alias("topics"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query(rf"SELECT conv_id, turn, md5(regexp_replace(block, '(\*\*Status:\*\*)[^\n]*', CASE WHEN conv_id % 2 = 0 THEN '\1 [x] approve  [ ] skip' ELSE '\1 [ ] approve  [x] skip' END)) AS block FROM ({_STAGED})")
def staged_decisions(spark, sf_dir):
    """Decisions written back into the staged text."""
    return _staged(spark, sf_dir).select("conv_id", "turn", F.md5(P.decided(F.col("block"), F.col("conv_id") % 2 == 0)).alias("block"))


@query(
    "SELECT conv_id, md5(array_to_string(list_concat(['---', 'title: ' || left(v, 80), 'category: 99-general', 'source_type: conversation', 'provenance: self-derived', 'claim_level: Inference', 'episodes: [\"e' || (conv_id % 5) || '\", \"f\"]', 'candidate_id: c' || conv_id, 'created: 2024-07-01', '---', '', '# ' || left(v, 120), '', v, '', '2 episodes', ''], ['- Episode: `e' || (conv_id % 5) || '`', '- Episode: `f`', '- Trace: `t`']), chr(10))) AS card FROM (SELECT conv_id, text AS v FROM conversations WHERE turn = 0)"
)
def promoted_cards(spark, sf_dir):
    """Promoted candidates as cards."""
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    e = F.array(F.lit("f"), F.concat(F.lit("e"), (F.col("conv_id") % 5).cast("string")), F.lit("f"))
    return c.select("conv_id", F.md5(P.promoted_card(F.col("text"), F.concat(F.lit("c"), F.col("conv_id").cast("string")), e, F.array(F.lit("t")), F.lit("2024-07-01"))).alias("card"))


@query("SELECT row_number() OVER (ORDER BY path) AS n, path, title FROM rows", views=("notes",), ctes=_ROWS)
def index_written(spark, sf_dir):
    """The index sorted by path, written whole and read back in that order."""
    rows = N.index_rows(notes(spark, sf_dir)).select("path", "title").orderBy("path")
    back = store.write(rows, store.new_folder(spark, "index"))
    return back.select(F.row_number().over(Window.orderBy("path")).cast("long").alias("n"), "path", "title")  # the order is the index's


@query("SELECT kind, count(*) AS n, sum(len(embedding))::BIGINT AS numbers, count(*) FILTER (vec_id % 50 = 7) AS asked FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 'section' ELSE 'card' END AS kind FROM embeddings) GROUP BY kind")
def vectors_written(spark, sf_dir):
    """Vectors by kind, written, read back whole or not at all, and some looked up by key."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 3 == 0, "section").otherwise("card").alias("kind"))
    back = store.valid_vectors(store.write(v, store.new_folder(spark, "vectors"), by=["kind"]), 64, v.count())
    asked = back.join(v.where("vec_id % 50 = 7").select("vec_id"), "vec_id", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("asked"))
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).cast("long").alias("numbers")).join(asked, "kind", "left").select("kind", "n", "numbers", F.coalesce("asked", F.lit(0)).alias("asked"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def log_appended(spark, sf_dir):
    """Lines of JSON appended in two parts and read back."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = store.new_folder(spark, "log")
    store.write(e.where("event_id % 2 = 0"), path, "append", kind="json")
    back = store.write(e.where("event_id % 2 = 1"), path, "append", kind="json")
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT key, max(n) AS n FROM (SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1) GROUP BY key")
def decisions_written(spark, sf_dir):
    """Keys of a stored table replaced by new ones, written whole."""
    e = table(spark, sf_dir, "events")
    of = lambda t: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    old = store.write(of("view"), store.new_folder(spark, "decisions"))
    return store.replace_keys(old, of("click"), "key", store.new_folder(spark, "decisions"))


@query(
    "SELECT key, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'gone' WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS state FROM (SELECT path AS key, md5(body) AS hash FROM notes WHERE lang <> 'fr') n FULL JOIN (SELECT path AS key, md5(CASE WHEN source = 'src1' THEN body || 'x' ELSE body END) AS hash FROM notes WHERE lang <> 'es') o USING (key)",
    views=("notes",),
)
def vector_changes(spark, sf_dir):
    """Which texts get a new vector, by digest; which keys go."""
    n = notes(spark, sf_dir)
    new = n.where("lang <> 'fr'").select(F.col("path").alias("key"), F.md5("body").alias("hash"))
    old = n.where("lang <> 'es'").select(F.col("path").alias("key"), F.md5(F.when(F.col("source") == "src1", F.concat("body", F.lit("x"))).otherwise(F.col("body"))).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("was") != F.col("hash"), "changed").otherwise("same")
    return new.join(old, "key", "full_outer").select("key", state.alias("state"))


@query("SELECT event_id, CASE WHEN ts::DATE >= DATE '2024-01-20' THEN 'recent' ELSE 'old' END AS age FROM events")
def log_entries(spark, sf_dir):
    """Entries of a log by the day in their heading."""
    head = F.concat(F.lit("## ["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] ingest | "), F.col("event_type"))
    day = F.try_to_date(F.regexp_extract(head, r"^## \[([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return table(spark, sf_dir, "events").select("event_id", F.when(day >= F.lit("2024-01-20").cast("date"), "recent").otherwise("old").alias("age"))


_SNAP = f"""SELECT 'items' AS metric, count(*)::BIGINT AS value FROM items UNION ALL SELECT 'active', count(*) FILTER (NOT excluded) FROM items UNION ALL SELECT 'excluded', count(*) FILTER (excluded) FROM items UNION ALL SELECT 'recent', count(*) FILTER (NOT excluded AND mtime >= 1700010000) FROM items
  UNION ALL SELECT 'cards', count(*) FROM items WHERE starts_with(path, 'memory/cards/') UNION ALL SELECT 'uncarded', count(*) FROM items WHERE NOT starts_with(path, 'memory/cards/') AND NOT enriched UNION ALL SELECT 'topics', count(*) FROM ({_PAGES}) UNION ALL SELECT 'staged', count(*) FROM conversations UNION ALL SELECT 'pending', count(*) FROM conversations WHERE (conv_id + turn) % 3 = 2"""


@query(_SNAP, items=True)
def pipeline_snapshot(spark, sf_dir):
    """What there is at each stage."""
    i = items(spark, sf_dir)
    card = F.startswith("path", F.lit("memory/cards/"))
    n = i.agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("excluded")).alias("active"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded") & (F.col("mtime") >= 1700010000)).alias("recent"), F.count_if(card).alias("cards"), F.count_if(~card & ~F.col("enriched")).alias("uncarded"))
    s = _staged(spark, sf_dir).agg(F.count(F.lit(1)).alias("staged"), F.count_if(F.col("c.status") == "pending").alias("pending"))
    t = _pages(spark, sf_dir).agg(F.count(F.lit(1)).alias("topics"))
    long = lambda df: df.unpivot([], df.columns, "metric", "value")
    return long(n).unionByName(long(t)).unionByName(long(s))


_TOPIC_MAP = "(VALUES ('en', 'topic-1'), ('de', 'topic-99999'), ('fr', 'topic-2'), ('fr', 'topic-99998')) m(category, topic)"


@query(f"SELECT c.category, c.n, count(m.topic) AS mapped, count(p.slug) AS existing FROM (SELECT category, count(*) AS n FROM items WHERE NOT excluded GROUP BY category HAVING count(*) >= 5) c LEFT JOIN {_TOPIC_MAP} ON c.category = m.category LEFT JOIN ({_PAGES}) p ON m.topic = p.slug GROUP BY ALL HAVING count(p.slug) = 0", items=True)
def mapped_gaps(spark, sf_dir):
    """Categories of five items and more of whose topics none exists; those that name topics that do not."""
    n = items(spark, sf_dir).where("not excluded").groupBy("category").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    m = spark.sql(f"SELECT * FROM {_TOPIC_MAP}")
    j = n.join(m, "category", "left").join(_pages(spark, sf_dir).select("slug"), F.col("topic") == F.col("slug"), "left")
    return j.groupBy("category", "n").agg(F.count("topic").alias("mapped"), F.count("slug").alias("existing")).where("existing = 0")


@query("SELECT round(count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'und')) / count(*), 3)::DOUBLE AS hit_rate, round((count(*) - count(DISTINCT md5(text))) / count(*), 3)::DOUBLE AS duplicate_rate, round(count(*) FILTER (len(trim(text)) < 80) / count(*), 3)::DOUBLE AS noise_rate, count(*) FILTER (contains(lower(text), 'the') OR contains(lower(text), 'und')) / count(*) >= 0.8 AS hits_enough FROM documents")
def recommendation_rates(spark, sf_dir):
    """Hits, duplicates and noise among recommendations, against what they should be."""
    t = F.lower("text")
    hit = F.count_if(F.contains(t, F.lit("the")) | F.contains(t, F.lit("und")))
    n = F.count(F.lit(1))
    d = table(spark, sf_dir, "documents")
    return d.agg(F.round(hit / n, 3).alias("hit_rate"), F.round((n - F.countDistinct(F.md5("text"))) / n, 3).alias("duplicate_rate"), F.round(F.count_if(F.length(F.trim("text")) < 80) / n, 3).alias("noise_rate"), (hit / n >= 0.8).alias("hits_enough"))


_KEYWORDS = {"prose": ("the", "und", "les"), "rare": ("zzz", "qqq")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS topic, greatest(1, sum({' + '.join(f'(len(lower(text)) - len(replace(lower(text), {w!r}, {chr(39) * 2}))) // {len(w)}' for w in ws)}))::BIGINT AS weight FROM documents" for k, ws in _KEYWORDS.items()))
def keyword_profile(spark, sf_dir):
    """How often each topic's keywords occur in all texts, one at least."""
    from cartulary.functions.text import occurrences

    t = F.lower("text")
    d = table(spark, sf_dir, "documents")
    sums = d.agg(*[F.greatest(F.lit(1), F.sum(sum((occurrences(t, F.lit(w)) for w in ws[1:]), occurrences(t, F.lit(ws[0]))))).cast("long").alias(k) for k, ws in _KEYWORDS.items()])
    return sums.unpivot([], list(_KEYWORDS), "topic", "weight")


@query("SELECT category, count(*) AS n, array_to_string(list(id ORDER BY doc_id), ',') AS ids FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS r FROM items WHERE NOT excluded) WHERE r <= 100 GROUP BY category", items=True)
def notebook_export(spark, sf_dir):
    """The first hundred items of each category, as a list. (The limit is the export's.)"""
    w = Window.partitionBy("category").orderBy("doc_id")
    rows = items(spark, sf_dir).where("not excluded").select("category", "id", "doc_id", F.row_number().over(w).alias("r")).where("r <= 100")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "id"))), lambda x: x.id), ",").alias("ids"))


@query("SELECT id, category, array_to_string(list_filter(tags, lambda t: contains(lower(t), 'src1')), ',') AS hits FROM items WHERE category = 'en' OR len(list_filter(tags, lambda t: contains(lower(t), 'src1'))) > 0", items=True)
def guide_cards(spark, sf_dir):
    """Cards of a category, or with a tag that holds a word."""
    hits = F.filter("tags", lambda t: F.contains(F.lower(t), F.lit("src1")))
    return items(spark, sf_dir).select("id", "category", hits.alias("h")).where((F.col("category") == "en") | (F.size("h") > 0)).select("id", "category", F.array_join("h", ",").alias("hits"))


@query(f"SELECT slug, '---' || chr(10) || 'title: T' || page_id || chr(10) || 'sources: ' || (page_id % 4) || chr(10) || 'status: active' || chr(10) || 'alpha: 1' || chr(10) || 'zeta: x' || chr(10) || '---' AS front FROM ({_PAGES})")
def rendered_front_matter(spark, sf_dir):
    """front matter with the known fields first."""
    s = lambda c: c.cast("string")
    m = F.create_map(F.lit("zeta"), F.lit("x"), F.lit("status"), F.lit("active"), F.lit("alpha"), F.lit("1"), F.lit("title"), F.concat(F.lit("T"), s(F.col("page_id"))), F.lit("sources"), s(F.col("page_id") % 4))
    return _pages(spark, sf_dir).select("slug", P.rendered(m).alias("front"))
