"""What a service answers, renders and rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions.predicates import allowed
from cartulary.functions.text import text_or_empty
from cartulary.operators import notes as N
from cartulary.operators import providers as V
from cartulary.plans.base import query
from cartulary.plans.note_queries import _ROWS
from cartulary.sources import store
from cartulary.sources.records import items, memory_lines, notes, table


@query(
    "SELECT 'memory' AS kind, path AS id, count(*) AS lines FROM memory WHERE regexp_extract(path, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) >= '2024-01-15' GROUP BY path UNION ALL SELECT 'trace', 'e' || conv_id, arg_max(len(text), turn) FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2 GROUP BY conv_id",
    views=("memory",),
)
def recent_inputs(spark, sf_dir):
    """Memory files of the last days by the date in their name, and the newest trace of each episode with a known schema (here turns of two conversations in three, and the first of the others)."""
    day = F.regexp_extract("path", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    files = memory_lines(spark, sf_dir).where(day >= "2024-01-15").groupBy(F.col("path").alias("id")).agg(F.count(F.lit(1)).alias("lines")).select(F.lit("memory").alias("kind"), "id", "lines")
    schema = F.when((F.col("conv_id") % 3 != 0) | (F.col("turn") < 2), "trace.v1").otherwise("other")
    traces = table(spark, sf_dir, "conversations").withColumn("schema", schema).where("schema = 'trace.v1'")
    newest = traces.groupBy("conv_id").agg(F.max_by(F.length("text").cast("long"), "turn").alias("lines"))
    return files.unionByName(newest.select(F.lit("trace").alias("kind"), F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("id"), "lines"))


@query(
    "SELECT i.doc_id, md5(coalesce(a.body, b.body, c.body, '')) AS body FROM items i LEFT JOIN (SELECT doc_id, body FROM notes WHERE folder = 'cards/' AND lang <> 'fr') a USING (doc_id) LEFT JOIN (SELECT doc_id, left(body, 100) AS body FROM notes WHERE lang <> 'de') b USING (doc_id) LEFT JOIN (SELECT doc_id, left(body, 10) AS body FROM notes) c USING (doc_id)",
    views=("items", "notes"),
)
def card_bodies(spark, sf_dir):
    """A card's text from the first of the places that has it: its card, its own path, the bookmarks."""
    n = notes(spark, sf_dir)
    a = n.where("folder = 'cards/' and lang <> 'fr'").select("doc_id", F.col("body").alias("a"))
    b = n.where("lang <> 'de'").select("doc_id", F.left("body", F.lit(100)).alias("b"))
    c = n.select("doc_id", F.left("body", F.lit(10)).alias("c"))
    i = items(spark, sf_dir).select("doc_id")
    return i.join(a, "doc_id", "left").join(b, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", F.md5(F.coalesce("a", "b", "c", F.lit(""))).alias("body"))


@query("SELECT path, row_number() OVER (ORDER BY mtime DESC, path) AS n FROM notes WHERE contains(path, '/inbox/') AND NOT contains(body, 'AI 濃縮')", views=("notes",))
def enrichment_queue(spark, sf_dir):
    """Notes of the inbox that are not condensed, the newest first."""
    n = notes(spark, sf_dir).where(F.contains("path", F.lit("/inbox/")) & ~F.contains("body", F.lit("AI 濃縮")))
    return n.select("path", F.row_number().over(Window.orderBy(F.desc("mtime"), "path")).cast("long").alias("n"))  # the queue is one order


@query("SELECT path, '/w/' || path AS url_path, title FROM rows WHERE source_url <> '' AND path IN (SELECT min(path) FROM rows WHERE source_url <> '' GROUP BY source_url)", views=("notes",), ctes=_ROWS)
def address_map(spark, sf_dir):
    """The path and title of each address (the first of equals)."""
    rows = N.index_rows(notes(spark, sf_dir)).where("source_url <> ''").groupBy("source_url").agg(F.min_by(F.struct("path", "title"), "path").alias("b"))
    return rows.select("b.path", F.concat(F.lit("/w/"), "b.path").alias("url_path"), "b.title")


@query(
    "SELECT i.doc_id, coalesce(nullif(n.s, ''), i.sensitivity) AS sensitivity, coalesce(nullif(n.ns, ''), i.namespace) AS namespace, coalesce(lower(coalesce(nullif(n.s, ''), i.sensitivity)), 'private') = 'public' OR coalesce(coalesce(nullif(n.ns, ''), i.namespace) = 'team-a', false) AS allowed FROM items i JOIN (SELECT doc_id, trim(regexp_extract(body, '(?m)^sensitivity:\\s*(.*)$', 1)) AS s, trim(regexp_extract(body, '(?m)^namespace:\\s*(.*)$', 1)) AS ns FROM notes) n USING (doc_id)",
    views=("items", "notes"),
)
def overlaid_rights(spark, sf_dir):
    """Rights of an index row, over which its note's front matter goes."""
    field = lambda k: F.nullif(F.trim(F.regexp_extract("body", rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    n = notes(spark, sf_dir).select("doc_id", field("sensitivity").alias("s"), field("namespace").alias("ns"))
    j = items(spark, sf_dir).join(n, "doc_id").select("doc_id", F.coalesce("s", "sensitivity").alias("sensitivity"), F.coalesce("ns", "namespace").alias("namespace"))
    return j.withColumn("allowed", allowed(F.col("sensitivity"), F.col("namespace"), "team-a"))


@query("SELECT doc_id, '[card] ' || title || chr(10) || summary AS context, '- ' || title || '：' || left(summary, 80) AS digest FROM items", items=True)
def rendered_context(spark, sf_dir):
    """Records as lines of a context and of a digest."""
    return items(spark, sf_dir).select("doc_id", F.concat(F.lit("[card] "), "title", F.lit("\n"), "summary").alias("context"), F.concat(F.lit("- "), "title", F.lit("："), F.left("summary", F.lit(80))).alias("digest"))


@query(
    "SELECT path, CASE WHEN regexp_matches(t, '^[0-9]{10,}$') THEN t WHEN regexp_matches(stem, '^[0-9]{10,}$') THEN stem ELSE '' END AS id, coalesce(nullif(trim(regexp_extract(body, '(?m)^title:\\s*\"?([^\"\\n]+)\"?\\s*$', 1)), ''), nullif(trim(regexp_extract(body, '(?m)^#\\s+(.+)$', 1)), ''), CASE WHEN regexp_matches(stem, '^[0-9]+$') THEN 'Tweet ' || stem ELSE stem END) AS title FROM (SELECT *, trim(regexp_extract(body, '(?m)^tweet_id:\\s*\"?([^\"\\n]+)\"?\\s*$', 1)) AS t FROM notes)",
    views=("notes",),
)
def queue_fields(spark, sf_dir):
    """Ids and titles of queued files, by their own ladders."""
    b, stem = F.col("body"), F.col("stem")
    field = lambda k: F.trim(F.regexp_extract(b, rf'(?m)^{k}:\s*"?([^"\n]+)"?\s*$', 1))
    t = field("tweet_id")
    ident = F.when(t.rlike("^[0-9]{10,}$"), t).when(stem.rlike("^[0-9]{10,}$"), stem).otherwise("")
    named = F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("Tweet "), stem)).otherwise(stem)
    title = F.coalesce(F.nullif(field("title"), F.lit("")), F.nullif(F.trim(F.regexp_extract(b, r"(?m)^#\s+(.+)$", 1)), F.lit("")), named)
    return notes(spark, sf_dir).select("path", ident.alias("id"), title.alias("title"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS kept FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' ELSE props END AS props FROM events)")
def safe_json(spark, sf_dir):
    """JSON that cannot be read counts as an empty object."""
    raw = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.col("props"))
    ok = F.coalesce(F.is_valid_variant(raw) if hasattr(F, "is_valid_variant") else F.try_parse_json(raw).isNotNull(), F.lit(False))
    kept = F.when(ok, raw).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(kept, "$.k").cast("long"), F.lit(-1)).alias("k"), kept.alias("kept"))


@query("SELECT conv_id, md5(string_agg(role || ' ' || text, ' ' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def flattened(spark, sf_dir):
    """nested records as one text, in order."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(" ", x.role, x.text))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(each, " ")).alias("text"))


@query("SELECT path, CASE WHEN contains(stem, 'pmc') THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC' || regexp_extract(stem, 'pmc([0-9]+)', 1) || '/' ELSE '' END AS url FROM notes", views=("notes",))
def paper_addresses(spark, sf_dir):
    """the address of an archive's article, by its number in a file's name."""
    number = F.regexp_extract("stem", "(?i)pmc([0-9]+)", 1)
    return notes(spark, sf_dir).select("path", F.when(number != "", F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), number, F.lit("/"))).otherwise("").alias("url"))


@query(
    "SELECT path, md5(CASE doc_id % 3 WHEN 0 THEN rtrim(body, chr(10)) || chr(10) || chr(10) || '## Media evidence' || chr(10) || 'seen ' || doc_id || chr(10) WHEN 1 THEN rtrim(body, chr(10)) || chr(10) || chr(10) || '## Media evidence' || chr(10) || 'old' || chr(10) ELSE rtrim(body, chr(10)) || chr(10) || chr(10) || '## Media evidence' || chr(10) || 'seen ' || doc_id || chr(10) END) AS body FROM notes",
    views=("notes",),
)
def media_evidence(spark, sf_dir):
    """What a vision model saw, written into notes: kept where there is some already, replaced by force. The model is injected; here a stand-in."""
    n = notes(spark, sf_dir)
    plain = F.regexp_replace("body", r"\n+\z", "")
    there = F.when(F.col("doc_id") % 3 > 0, F.concat(plain, F.lit("\n\n## Media evidence\nold\n"))).otherwise(F.col("body"))
    n = n.select("path", "doc_id", there.alias("body"), F.concat(F.lit("see "), F.col("doc_id").cast("string")).alias("prompt"), F.col("doc_id").cast("string").alias("image"))
    said = V.answered(n, "image", "prompt", _see)
    block = F.concat(F.lit("\n\n## Media evidence\n"), F.col("answer"), F.lit("\n"))
    has, force = F.contains("body", F.lit("## Media evidence")), F.col("doc_id") % 3 == 2
    bare = F.regexp_replace(F.regexp_replace("body", r"\n*## Media evidence\n[^#]*", ""), r"\n+\z", "")
    return n.join(said, "image").select("path", F.md5(F.when(has & ~force, F.col("body")).otherwise(F.concat(bare, block))).alias("body"))


def _see(prompts: list[str]) -> list:
    return ["seen" + p[3:] for p in prompts]


def _adapter(requests: list[str]) -> list:
    import json

    return [json.dumps({"status": "ok" if json.loads(r)["n"] % 2 else "failed", "n": json.loads(r)["n"]}) for r in requests]


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'ok' ELSE 'failed' END AS status FROM events")
def adapter_results(spark, sf_dir):
    """Requests to an adapter and its results, in JSON."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("n"))).alias("request"))
    said = V.answered(e, "event_id", "request", _adapter)
    return said.select("event_id", F.get_json_object("answer", "$.status").alias("status"))


@query("SELECT doc_id, CASE WHEN l.quality = 1 THEN 'done' WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 5 = 1 THEN 'skipped' ELSE 'todo' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) WHERE doc_id IS NOT NULL")
def queue_written(spark, sf_dir):
    """A queue rewritten: done where a card exists, failed and skipped ones as they were, the rest to do; written and read back."""
    d = table(spark, sf_dir, "documents").select("doc_id").where("doc_id is not null")
    cards = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    was = F.when(F.col("doc_id") % 5 == 0, "failed").when(F.col("doc_id") % 5 == 1, "skipped")
    rows = d.join(cards, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "done").otherwise(F.coalesce(was, F.lit("todo"))).alias("status"))
    return store.write(rows, store.new_folder(spark, "queue"), kind="json")


@query("SELECT d::DATE::VARCHAR AS day, count(e.event_id) AS n FROM generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) g(d) LEFT JOIN events e ON e.ts::DATE = g.d::DATE GROUP BY 1")
def dated_jobs(spark, sf_dir):
    """A job for each day of a range, with what there is of the day."""
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS day")
    n = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY category ORDER BY len(summary) DESC, doc_id) AS place FROM items", items=True)
def stable_order(spark, sf_dir):
    """Equal scores keep the order of the input, by an explicit last key."""
    w = Window.partitionBy("category").orderBy(F.length("summary").desc(), "doc_id")
    return items(spark, sf_dir).select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT doc_id, '{\"id\":\"' || id || '\",\"category\":\"' || category || '\",\"excluded\":' || excluded || '}' AS response FROM items", items=True)
def responses(spark, sf_dir):
    """Records as a service sends them."""
    return items(spark, sf_dir).select("doc_id", F.to_json(F.struct("id", "category", "excluded")).alias("response"))


@query("SELECT doc_id, id FROM (SELECT doc_id, id, row_number() OVER (ORDER BY doc_id) AS r FROM items WHERE (id = '7' OR contains(lower(source_url), 'github.com/en')) AND (coalesce(lower(sensitivity), 'private') = 'public' OR coalesce(namespace = 'team-a', false))) WHERE r <= 20", items=True)
def source_lookup(spark, sf_dir):
    """Items by id or a part of their address that a namespace may see, twenty at most. (The limit is the service's.)"""
    i = items(spark, sf_dir)
    hit = (F.col("id") == "7") | F.contains(F.lower(text_or_empty(F.col("source_url"))), F.lit("github.com/en"))
    return i.where(hit & allowed(F.col("sensitivity"), F.col("namespace"), "team-a")).orderBy("doc_id").limit(20).select("doc_id", "id")


@query(
    "SELECT conv_id * 1000 + turn AS id, CASE WHEN rn = 1 THEN 'fetch' ELSE 'known' END AS step FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY conv_id, turn) AS rn FROM conversations)"
)
def crawl_steps(spark, sf_dir):
    """The ids of a crawl, of which each content is fetched once."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.md5("text").alias("h"), "conv_id", "turn")
    first = c.groupBy("h").agg(F.min(F.struct("conv_id", "turn", "id")).alias("b")).select(F.col("b.id").alias("id"), F.lit(True).alias("one"))
    return c.join(first, "id", "left").select("id", F.when(F.col("one"), "fetch").otherwise("known").alias("step"))
