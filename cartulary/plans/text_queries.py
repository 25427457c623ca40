"""Scalar functions over the tables (F) and derived columns (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.plans.base import query
from cartulary.sources.records import front_matter, items, messages, notes, table


@query("SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_\\-]{2,}|[一-鿿]+'))) AS n_tokens, lower(regexp_extract(lower(text), '[a-z0-9_\\-]{2,}')) AS first_token FROM benchmark")
def tokenize_queries(spark, sf_dir):
    """tokens of each benchmark text."""
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(t).cast("long").alias("n_tokens"), t[0].alias("first_token"))


_RUNS = "regexp_extract_all(lower(message), '[a-z0-9_\\-]{2,}|[一-鿿]+')"
_GRAMS = "CASE WHEN regexp_matches(r, '^[一-鿿]+$') THEN list_concat(CASE WHEN len(r) <= 3 THEN [r] ELSE [] END, list_transform(range(1, greatest(len(r), 1)), lambda i: substr(r, i, 2)), list_transform(range(1, greatest(len(r) - 1, 1)), lambda i: substr(r, i, 3))) ELSE [r] END"


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform({_RUNS}, lambda r: {_GRAMS})), lambda t: len(t) >= 2))), ' ') AS tokens FROM messages", views=("messages",))
def tokenize_cjk(spark, sf_dir):
    """words and n-grams of CJK runs, of every message."""
    return messages(spark, sf_dir).select("conv_id", "turn", F.array_join(F.array_sort(T.tokenize(F.col("message"))), " ").alias("tokens"))


_ASKED = ("怎麼", "麼設", "設計", "怎麼設", "麼設計", "workflow")


@query(
    f"SELECT conv_id, turn, len(list_distinct(flatten(list_transform(list_filter([{', '.join(repr(t) for t in _ASKED)}], lambda t: contains(lower(message), t)), lambda t: CASE WHEN t = 'workflow' THEN [t] ELSE string_split(t, '') END))))::DOUBLE / 5 AS score FROM messages",
    views=("messages",),
)
def overlap_scores(spark, sf_dir):
    """how much of a question each message holds: CJK counts by character, Latin by word."""
    asked = T.tokenize(F.lit("怎麼設計 workflow"))
    return messages(spark, sf_dir).select("conv_id", "turn", T.overlap_score(asked, F.col("message")).cast("double").alias("score"))


@query("SELECT doc_id, len(text) + 2 * len(regexp_extract_all(text, '[一-鿿]')) AS info_length FROM documents")
def information_lengths(spark, sf_dir):
    """F05."""
    return table(spark, sf_dir, "documents").select("doc_id", T.information_length(F.col("text")).cast("long").alias("info_length"))


@query("SELECT doc_id, (len(lower(text)) - len(replace(lower(text), 'the', ''))) // 3 AS n_the, (len(text) - len(replace(text, 'tion', ''))) // 4 AS n_tion FROM documents")
def term_occurrences(spark, sf_dir):
    """R19's counts: non-overlapping occurrences."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.occurrences(F.lower("text"), F.lit("the")).cast("long").alias("n_the"), T.occurrences(F.col("text"), F.lit("tion")).cast("long").alias("n_tion"))


@query(
    r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(summary), '^#+\s*', ''), '^[-•]\s*', ''), '\s+', ' ', 'g')) AS clean,
  regexp_extract(source_url, '/(?:status|i/status)/([0-9]{15,20})', 1) AS status_id,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, left(md5(title), 12) AS title_hash, sha1(path) AS path_sha1, sha256(summary) AS summary_sha256,
  lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS statement FROM items""",
    items=True,
)
def cleaned_items(spark, sf_dir):
    """cleaned summary, statement, status id, digests."""
    c = F.col
    return items(spark, sf_dir).select("id", T.clean_summary(c("summary")).alias("clean"), T.status_id(c("source_url")).alias("status_id"), T.stem(c("path")).alias("stem"), T.digest_id(c("title")).alias("title_hash"), F.sha1("path").alias("path_sha1"), F.sha2("summary", 256).alias("summary_sha256"), T.normal_statement(c("title")).alias("statement"))


@query(
    r"""SELECT id, left(trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '-'), 60) AS slug,
  coalesce(nullif(left(trim(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_]+', '_', 'g'), '_'), 160), ''), 'unknown') AS key,
  trim(regexp_replace(lower(trim(title)), '[^\p{L}\p{N}_\s]', '', 'g')) AS plain FROM items""",
    items=True,
)
def slugs_and_keys(spark, sf_dir):
    """F23, F24, F26."""
    return items(spark, sf_dir).select("id", T.slug(F.col("title")).alias("slug"), T.normal_key(F.col("title")).alias("key"), T.normal_title(F.col("title")).alias("plain"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS n_links, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading FROM pages")
def page_links(spark, sf_dir):
    """Host, links and heading of a page."""
    p = table(spark, sf_dir, "pages")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return p.select("page_id", F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), F.size(links).cast("long").alias("n_links"), F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("heading"))


@query(r"SELECT id, CASE WHEN id = '' OR regexp_matches(id, '^[a-z]+:') THEN '' ELSE id || '.md' END AS key, CASE WHEN path LIKE '%.md' THEN path ELSE path || '.md' END AS path_key, source_url || '|' || source_type AS dedup_key FROM items", items=True)
def vector_keys(spark, sf_dir):
    """F31, F41."""
    return items(spark, sf_dir).select("id", T.vector_key(F.col("id")).alias("key"), T.vector_key(F.col("path")).alias("path_key"), F.concat_ws("|", "source_url", "source_type").alias("dedup_key"))


@query("SELECT id, CASE WHEN title <> '' AND NOT regexp_matches(title, '^[0-9]{10,}$') THEN title WHEN trim(summary) <> '' AND trim(summary) <> '待整理' THEN left(split_part(trim(summary), '.', 1), 60) ELSE title END AS shown, left(concat_ws('. ', title, nullif(summary, '')), 900) AS embed_text, CASE WHEN starts_with(source_url, 'https://github.com') THEN 'github' WHEN contains(source_url, 'x.com') THEN 'x' WHEN source_url = '' THEN 'none' ELSE 'web' END AS kind, split_part(path, '/', 3) AS folder FROM items", items=True)
def derived_columns(spark, sf_dir):
    """Shown title, embeddable text, kind, folder."""
    s = F.trim("summary")
    shown = F.when((F.col("title") != "") & ~F.col("title").rlike("^[0-9]{10,}$"), F.col("title")).when((s != "") & (s != "待整理"), F.left(F.split_part(s, F.lit("."), F.lit(1)), F.lit(60))).otherwise(F.col("title"))
    url = F.col("source_url")
    kind = F.when(url.startswith("https://github.com"), "github").when(url.contains("x.com"), "x").when(url == "", "none").otherwise("web")
    return items(spark, sf_dir).select("id", shown.alias("shown"), F.left(F.concat_ws(". ", "title", F.nullif(F.col("summary"), F.lit(""))), F.lit(900)).alias("embed_text"), kind.alias("kind"), F.split_part("path", F.lit("/"), F.lit(3)).alias("folder"))


@query("SELECT doc_id, round(least(1.0, n_chars / 10000.0), 6)::DOUBLE AS quality_score, ceil(least(n_chars, 72000) / 6000.0)::BIGINT AS chunks, greatest(1, least(12, ceil(n_chars / 6000.0)))::BIGINT AS capped FROM documents")
def content_chunks(spark, sf_dir):
    """Quality by length, chunks of 6,000 characters."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.least(F.lit(1.0), n / 10000.0), 6).alias("quality_score"), F.ceil(F.least(n, F.lit(72000)) / 6000.0).cast("long").alias("chunks"), F.greatest(F.lit(1), F.least(F.lit(12), F.ceil(n / 6000.0))).cast("long").alias("capped"))


@query("SELECT doc_id, i.i AS line_no, trim(string_split(text, chr(10))[i.i]) AS line, CASE WHEN len(trim(string_split(text, chr(10))[i.i])) > 60 THEN 'long' ELSE 'short' END AS kind FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) i")
def page_lines(spark, sf_dir):
    """Lines of each text, numbered and classed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    line = F.trim("l")
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), line.alias("line"), F.when(F.length(line) > 60, "long").otherwise("short").alias("kind"))


@query(f"SELECT conv_id, turn, translate(message, '{T.SIMPLIFIED}', '{T.TRADITIONAL}') AS mapped FROM (SELECT conv_id, turn, '这条记忆终' || message || '决定设计' AS message FROM messages)", views=("messages",))
def mapped_text(spark, sf_dir):
    """simplified characters by the map."""
    t = F.concat(F.lit("这条记忆终"), F.col("message"), F.lit("决定设计"))
    return messages(spark, sf_dir).select("conv_id", "turn", T.to_traditional(t).alias("mapped"))


@query(r"SELECT path, md5(regexp_replace(body, '(?is)<think>.*?</think>', '', 'g')) AS plain FROM notes", views=("notes",))
def without_thoughts(spark, sf_dir):
    """notes without thought blocks, whole (kept untrimmed here)."""
    return notes(spark, sf_dir).select("path", F.md5(F.regexp_replace("body", r"(?is)<think>.*?</think>", "")).alias("plain"))


_WORDS = ("the", "of", "and", "from", "there")


@query(
    f"""SELECT d.doc_id, CASE WHEN len(clean) <= 200 THEN clean WHEN len(snippet) > 200 THEN left(snippet, 199) || '…' ELSE snippet END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\n+', ' ', 'g')) AS clean FROM documents) d LEFT JOIN (
  SELECT b.doc_id, array_to_string(list_slice(ws, b.i, b.i + 29), ' ') AS snippet FROM (SELECT doc_id, arg_max(i, (s, -i)) AS i FROM (
      SELECT doc_id, i, n, {' + '.join(f"max(contains(w, '{t}')::INT) OVER x" for t in _WORDS)} AS s FROM (SELECT doc_id, lower(unnest(ws)) AS w, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM words) WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
    WHERE i <= greatest(n - 30, 1) GROUP BY doc_id) b JOIN words USING (doc_id)) s ON d.doc_id = s.doc_id""",
    ctes=r"words AS (SELECT doc_id, list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '\n+', ' ', 'g')), '\s+'), lambda w: w <> '') AS ws FROM documents)",
)
def best_excerpts(spark, sf_dir):
    """The 30-word window of each text that matches a query best."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    return table(spark, sf_dir, "documents").select("doc_id", T.best_window(F.col("text"), words).alias("excerpt"))


@query(
    r"SELECT doc_id, count(*) FILTER (kind = 'link') AS links, count(*) FILTER (kind = 'bullet') AS bullets, count(*) FILTER (kind = 'prose') AS prose, round(count(*) FILTER (kind = 'bullet') / 8.0, 4) AS ratio FROM (SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*-\s*\[[^\]]+\]\(https?://') THEN 'link' WHEN regexp_matches(line, '^\s*-\s+\S') AND len(trim(line)) > 60 THEN 'bullet' ELSE 'prose' END AS kind FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '- [a](https://x.org) ' || l WHEN 1 THEN '- ' || l ELSE l END AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))) GROUP BY doc_id"
)
def page_parts(spark, sf_dir):
    """A page's links, long bullets and prose, and what eight conclusions would condense its bullets to."""
    line = F.expr("CASE doc_id % 3 WHEN 0 THEN '- [a](https://x.org) ' || l WHEN 1 THEN '- ' || l ELSE l END")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", T.line_kind(line).alias("kind"))
    n = {k: F.count_if(F.col("kind") == k) for k in ("link", "bullet", "prose")}
    return d.groupBy("doc_id").agg(n["link"].alias("links"), n["bullet"].alias("bullets"), n["prose"].alias("prose"), F.round(n["bullet"] / 8.0, 4).alias("ratio"))


@query(
    r"SELECT doc_id, k, md5(string_agg(shown, ' ' ORDER BY i)) AS bullet FROM (SELECT doc_id, i, (sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS k, starts, CASE WHEN starts THEN rtrim(l) ELSE trim(l) END AS shown, l FROM (SELECT *, starts_with(trim(l), '- ') OR starts_with(trim(l), '* ') AS starts FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS l, unnest(range(len(string_split(body, chr(10))))) AS i FROM notes))) WHERE k BETWEEN 1 AND 2 AND (starts OR trim(l) <> '') GROUP BY doc_id, k",
    views=("notes",),
)
def first_bullets(spark, sf_dir):
    """A page's first two bullets with their continuations."""
    b = notes(spark, sf_dir).select("doc_id", F.posexplode(T.take_bullets(F.col("body"), 2)).alias("p", "b"))
    return b.select("doc_id", (F.col("p") + 1).cast("long").alias("k"), F.md5("b").alias("bullet"))


@query(
    r"SELECT id, left(trim(regexp_replace(lower(trim(title)), '[^a-z0-9一-鿿]+', '-', 'g'), '-'), 48) AS category, coalesce(nullif(left(trim(regexp_replace(lower(title), '[^a-z0-9._:-]+', '_', 'g'), '_'), 200), ''), 'unknown') AS artifact, trim(regexp_replace(regexp_replace(lower(trim(title)), '\s+', '-', 'g'), '[^a-z0-9_\-一-鿿]', '', 'g'), '-_') AS tag, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 80) AS playlist FROM items",
    items=True,
)
def slugs(spark, sf_dir):
    """slugs of categories, artifacts, tags and playlists."""
    t = F.col("title")
    return items(spark, sf_dir).select("id", *[T.slug_of(t, kind).alias(kind) for kind in ("category", "artifact", "tag", "playlist")])


@query(r"SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_extract(body, '\A(?:<think>(?s:.*?)</think>\n)?---\n(?s:(.*?))\n---\n', 1), '(?m)^([A-Za-z_]+):', 1))), ',') AS keys, trim(regexp_extract(body, '(?m)^category:[ \t]*\"?([^\"\n]*)\"?[ \t]*$', 1)) AS category FROM notes".replace("\\\\", "\\").replace('\\"', '"'), views=("notes",))
def front_matter_maps(spark, sf_dir):
    """Front matter as a map, and one of its values."""
    body = F.regexp_replace("body", r"\A<think>(?s:.*?)</think>\n", "")
    return notes(spark, sf_dir).select("path", F.coalesce(F.array_join(F.array_sort(F.map_keys(front_matter(body))), ","), F.lit("")).alias("keys"), T.front_matter_value(F.col("body"), "category").alias("category"))
