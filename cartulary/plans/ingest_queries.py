"""Ingest and injected providers (S21-S30, S32, S35, S36, S39, P09, D18, D20, D34, D40, D41, D49, F21, F28, F38, F41, R24, R26, R27, X01, X02, X05, X07, M20, I01-I08, I11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.operators import ingest as G
from cartulary.operators import providers as V
from cartulary.plans.base import query
from cartulary.sources.records import article, items, notes, subtitle_text, table

_VTT = "SELECT doc_id, 'WEBVTT' || nl || 'Kind: captions' || nl || nl || '1' || nl || '00:00.000 --> 00:01.000' || nl || '<c>' || replace(replace(text, '<', ' '), nl, nl || nl || '2' || nl || '00:01.000 --> 00:02.000' || nl) || nl || 'end' || nl || 'end' AS vtt FROM (SELECT doc_id, text, chr(10) AS nl FROM documents)"


def _of(spark, sf_dir, sql, name):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


@query(
    f"SELECT doc_id, sum(len(l))::BIGINT + count(*) - 1 AS length FROM (SELECT DISTINCT doc_id, l FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(vtt, chr(10))), '<[^>]*>', '', 'g')) AS l FROM ({_VTT})) WHERE l <> '' AND NOT starts_with(l, 'WEBVTT') AND NOT regexp_matches(l, '^(Kind|Language|NOTE)\\b|-->|^[0-9]+$')) GROUP BY doc_id"
)
def transcripts(spark, sf_dir):
    """Subtitles as text, each line once."""
    return _of(spark, sf_dir, _VTT, "documents").select("doc_id", F.length(subtitle_text(F.col("vtt"))).cast("long").alias("length"))


_XML = '''SELECT doc_id, '<article><article-title>T ' || doc_id || '</article-title><contrib contrib-type="author"><surname>A</surname></contrib><contrib><surname>B</surname></contrib><abstract><p>short</p></abstract><body><p>' || replace(replace(replace(replace(text, '&', 'and'), '<', ' '), '>', ' '), chr(10), '</p><p>') || '</p></body></article>' AS xml FROM documents'''
_PARAS = "list_filter(string_split(replace(replace(replace(text, '&', 'and'), '<', ' '), '>', ' '), chr(10)), lambda p: len(p) > 30)"


@query(f"SELECT doc_id, CASE WHEN len(t) >= 300 THEN md5(t) END AS text FROM (SELECT doc_id, trim('# T ' || doc_id || chr(10) || chr(10) || '**Authors:** A, B' || chr(10) || chr(10) || '## Abstract' || chr(10) || 'short' || chr(10) || chr(10) || array_to_string({_PARAS}, chr(10))) AS t FROM documents)")
def articles(spark, sf_dir):
    """Articles in XML as text: five authors, paragraphs of over 30 characters, 300 characters at least."""
    a = _of(spark, sf_dir, _XML, "documents").select("doc_id", article(F.col("xml")).alias("a"))
    return a.select("doc_id", F.md5(G.article_text(F.col("a.title"), F.col("a.abstract"), F.col("a.authors"), F.col("a.paragraphs"))).alias("text"))


_LIST = "SELECT page_id, 'v' || (page_id % 60) || chr(9) || 'T' || page_id || chr(9) || (page_id * 7) || chr(9) || 'chan' AS line FROM pages"


@query("SELECT v.id, v.title, v.seconds, v.lang FROM (SELECT 'v' || (page_id % 60) AS id, arg_min('T' || page_id, page_id) AS title, arg_min(page_id * 7, page_id)::BIGINT AS seconds, CASE WHEN min(page_id) % 3 = 0 THEN 'zh-TW' WHEN min(page_id) % 3 = 1 THEN 'en' END AS lang FROM pages GROUP BY 1) v WHERE v.id NOT IN (SELECT DISTINCT 'v' || (doc_id % 60) FROM documents WHERE doc_id % 60 < 20)")
def new_videos(spark, sf_dir):
    """A playlist's listing, without the videos there are; the subtitles' language by preference."""
    f = F.from_csv("line", "id string, title string, seconds long, channel string", {"sep": "\t"})
    rows = _of(spark, sf_dir, _LIST, "pages").select("page_id", f.alias("f"))
    first = rows.groupBy("f.id").agg(F.min_by(F.struct("f.title", "f.seconds"), "page_id").alias("b"), F.min("page_id").alias("p"))
    known = table(spark, sf_dir, "documents").where("doc_id % 60 < 20").select(F.concat(F.lit("v"), (F.col("doc_id") % 60).cast("string")).alias("id")).distinct()
    langs = F.when(F.col("p") % 3 == 0, F.array(F.lit("en"), F.lit("zh-TW"))).when(F.col("p") % 3 == 1, F.array(F.lit("fr"), F.lit("en"))).otherwise(F.array(F.lit("fr")))
    return first.join(known, "id", "left_anti").select("id", "b.title", "b.seconds", G.preferred(langs).alias("lang"))


@query(
    "SELECT conv_id, md5(left(string_agg('[' || (turn + 1) || '] ' || clean, chr(10) || chr(10) ORDER BY turn), 20000)) AS text, least(10, count(*) FILTER (turn > 0)) AS additions FROM (SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS clean FROM conversations) WHERE len(clean) >= 80 GROUP BY conv_id"
)
def threads(spark, sf_dir):
    """Threads in JSON, in their four envelopes; posts that say little go."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("ts"), F.count(F.lit(1)).alias("n"))
    posts = F.transform("ts", lambda x: F.struct(x.text.alias("text")))
    k = F.col("conv_id") % 4
    raw = F.when(k == 0, F.to_json(posts)).when(k == 1, F.to_json(F.struct(posts.alias("tweets")))).when(k == 2, F.to_json(F.struct(posts.alias("thread")))).otherwise(F.to_json(F.struct(posts.alias("data"))))
    t = c.select("conv_id", G.thread(raw).alias("t")).where("t.text <> ''")
    return t.select("conv_id", F.md5("t.text").alias("text"), F.size("t.additions").cast("long").alias("additions"))


@query(
    "SELECT doc_id, score, slug, md5(string_agg(CASE WHEN i % 3 = 0 THEN l ELSE l END, chr(10) ORDER BY i)) AS text FROM (SELECT doc_id, i, l, (0.5 + (i // 3) / 100.0)::DOUBLE AS score, 's' || (i // 3) AS slug FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE i % 3 = 0 OR (trim(l) <> '' AND NOT starts_with(l, '['))) GROUP BY doc_id, score, slug"
)
def scored_lines(spark, sf_dir):
    """Results in lines, with the lines that continue them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    k = F.floor(F.col("i") / 3)
    head = F.concat(F.lit("["), F.format_string("%.2f", 0.5 + k / 100.0), F.lit("] s"), k.cast("string"), F.lit(" -- "), F.col("l"))
    rows = d.withColumn("line", F.when(F.col("i") % 3 == 0, head).otherwise(F.col("l")))
    return G.scored_lines(rows, "doc_id", "i", "line").withColumn("text", F.md5("text"))


@query("SELECT conv_id, string_agg((1000 + turn)::VARCHAR, ',' ORDER BY turn) AS ids, CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id END AS cursor FROM conversations GROUP BY conv_id")
def timelines(spark, sf_dir):
    """The posts and the cursor of pages of a timeline."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit('{"entryId": "tweet-'), (t + 1000).cast("string"), F.lit('", "content": {}}'))), ", ").alias("es"))
    cursor = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(', {"entryId": "cursor-bottom-9", "content": {"entryType": "TimelineTimelineCursor", "value": "c'), F.col("conv_id").cast("string"), F.lit('"}}'))).otherwise("")
    raw = F.concat(F.lit('{"data": {"deep": [{"entries": ['), F.col("es"), cursor, F.lit("]}]}}"))
    return c.select("conv_id", G.timeline(raw).alias("t")).select("conv_id", F.array_join("t.ids", ",").alias("ids"), "t.cursor")


@query("SELECT doc_id, 'https://github.com/' || lang || '/' || (doc_id % 50) || '|' || CASE doc_id % 2 WHEN 0 THEN 'star' ELSE 'fork' END AS key FROM documents WHERE doc_id % 5 <> 0 AND (doc_id % 3 > 0 OR doc_id % 7 = 0) AND doc_id % 50 >= 10")
def new_repositories(spark, sf_dir):
    """Repositories that are not archived and say something, without those there are by address and kind."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://github.com/"), "lang", F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    rows = d.select("doc_id", F.concat_ws("|", url, F.when(F.col("doc_id") % 2 == 0, "star").otherwise("fork")).alias("key"), (F.col("doc_id") % 5 == 0).alias("archived"), F.when(F.col("doc_id") % 3 > 0, "about").alias("description"), F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("t"))).alias("topics"))
    known = rows.where("doc_id % 50 < 10").select("key").distinct()
    return rows.where(G.wanted_repository(F.col("archived"), F.col("description"), F.col("topics"))).join(known, "key", "left_anti").select("doc_id", "key")


_PAPER = "SELECT doc_id, 'p_' || doc_id AS stem, CASE doc_id % 3 WHEN 0 THEN '# Head ' || doc_id || chr(10) || '**Authors:** A and B' || chr(10) || text ELSE text END AS body FROM documents"


@query(
    f"SELECT doc_id, CASE WHEN n >= 200 THEN CASE WHEN doc_id % 3 = 0 THEN 'Head ' || doc_id ELSE 'p ' || doc_id END END AS title, CASE WHEN n >= 200 THEN CASE WHEN doc_id % 3 = 0 THEN 'A and B' ELSE '' END END AS author, CASE WHEN n >= 200 THEN md5(CASE WHEN len(s) > 480 THEN left(s, 480) || '…' ELSE s END) END AS excerpt, CASE WHEN n >= 200 THEN round(least(1.0, n / 10000.0), 6)::DOUBLE END AS quality FROM (SELECT *, len(body) AS n, trim(replace(left(body, 500), chr(10), ' ')) AS s FROM ({_PAPER}))"
)
def papers(spark, sf_dir):
    """Title, author, excerpt and quality of papers of 200 characters and more."""
    p = _of(spark, sf_dir, _PAPER, "documents").select("doc_id", G.paper(F.col("body"), F.col("stem")).alias("p"))
    return p.select("doc_id", "p.title", "p.author", F.md5("p.excerpt").alias("excerpt"), F.round("p.quality", 6).alias("quality"))


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: len(x) > 3 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '(?i)^(arXiv|doi:|https?://|©|Copyright|All rights reserved)')), chr(10))) AS text FROM documents")
def clean_papers(spark, sf_dir):
    """A paper's text without page numbers, heads and feet. Pages of PDF files reach it as text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(G.clean_paper(F.col("text"))).alias("text"))


@query(
    r"SELECT doc_id, CASE WHEN len(line) > 80 THEN rtrim(left(line, 80)) || '…' ELSE line END AS line, md5(array_to_string(s[1:3], '|')) AS points FROM (SELECT doc_id, s, CASE WHEN len(s) > 0 THEN s[1] ELSE 'none' END AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]+\]\([^)]+\)', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')), '[。！？!?.]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))"
)
def local_summaries(spark, sf_dir):
    """Summaries by rule, where no model is at hand."""
    s = table(spark, sf_dir, "documents").select("doc_id", G.local_summary(F.col("text"), F.lit("none")).alias("s"))
    return s.select("doc_id", "s.line", F.md5(F.array_join("s.points", "|")).alias("points"))


@query("SELECT conv_id, arg_max(turn, (k * 10 + s, -turn)) AS turn FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 9 ELSE 1 END AS k, conv_id * turn % 11 AS s FROM conversations) GROUP BY conv_id")
def thumbnails(spark, sf_dir):
    """The image of each group that says most."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 4 == 0, "diagram").when(F.col("turn") % 4 == 1, "result_image").when(F.col("turn") % 4 == 2, "storyboard").otherwise("blurred")
    return G.best_thumbnail(c.select("conv_id", "turn", kind.alias("kind"), (F.col("conv_id") * F.col("turn") % 11).alias("score")), "conv_id", "turn")


@query("SELECT path, CASE doc_id % 7 WHEN 0 THEN 'https://x.com/i/status/' || stem WHEN 1 THEN 'https://github.com/o/n' || doc_id WHEN 3 THEN 'https://www.youtube.com/watch?v=' || lpad('' || doc_id, 11, 'a') ELSE '' END AS url, CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' ELSE '.jpg' END AS ending FROM notes", views=("notes",))
def slug_addresses(spark, sf_dir):
    """The addresses that slugs stand for, and the endings of media."""
    n = notes(spark, sf_dir)
    k = F.col("doc_id") % 7
    slug = F.when(k == 0, F.col("stem")).when(k == 1, F.concat(F.lit("github_star-o-n"), F.col("doc_id").cast("string"))).when(k == 3, F.concat(F.lit("youtube-"), F.lpad(F.col("doc_id").cast("string"), 11, "a"))).otherwise("note")
    m = F.col("doc_id") % 5
    url = F.when(m == 0, "https://x.org/a?format=png&s=1").when(m == 1, "https://x.org/a?format=jpeg").otherwise("https://x.org/a")
    return n.select("path", G.slug_address(slug).alias("url"), G.extension(url, F.when(m == 2, "image/webp")).alias("ending"))


@query("SELECT 'local|' || left(md5(body), 8) AS key, min(path) AS path, left(md5(body), 8) AS id FROM notes GROUP BY left(md5(body), 8) HAVING 'local|' || left(md5(body), 8) NOT IN (SELECT 'local|' || left(md5(body), 8) FROM notes WHERE doc_id % 4 = 0)", views=("notes",))
def new_local_notes(spark, sf_dir):
    """Local notes that are not known, by their content."""
    n = notes(spark, sf_dir)
    known = n.where("doc_id % 4 = 0").select(F.concat(F.lit("local|"), F.left(F.md5("body"), F.lit(8))).alias("key")).distinct()
    return G.new_notes(n.select("path", "body"), known)


@query("SELECT id, CASE WHEN s IN ('', '待整理', '待補充', '###') OR len(s) < 10 THEN '' ELSE CASE WHEN len(f) < 8 THEN '' ELSE f END END AS suggested FROM (SELECT id, s, trim(left(trim(split_part(split_part(s, '。', 1), '.', 1)), 48), ' -—–_。.') AS f FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(trim(summary), '^#+\\s*', ''), '^[-•]\\s*', ''), '\\s+', ' ', 'g')) AS s FROM items))", items=True)
def suggested_titles(spark, sf_dir):
    """Titles from summaries: the first sentence, 48 characters, eight at least."""
    return items(spark, sf_dir).select("id", T.suggested_title(F.col("summary")).alias("suggested"))


@query(r'''SELECT path, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, 'https?://[^\s<>"'')\]]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))), ' ') AS urls FROM notes''', views=("notes",))
def note_addresses(spark, sf_dir):
    """the distinct addresses of notes, sorted."""
    return notes(spark, sf_dir).select("path", F.array_join(F.array_sort(T.extract_urls(F.col("body"))), " ").alias("urls"))


# --- injected providers: here deterministic stand-ins that know no model --------------------------


def classify_stub(prompts: list[str]) -> list:
    """Answers as a classifier would: some known, some new, some unreadable; a call of many prompts with 'zu' fails, as a busy service does."""
    if len(prompts) > 1 and any("zu" in p for p in prompts):
        raise TimeoutError
    return ['{"category": "01-trees", "confidence": "high"}' if len(p) % 4 == 0 else '<think>x</think>{"category": "NEW_CATEGORY", "new_category": "Quiet Places", "confidence": "high"}' if len(p) % 4 == 1 else '{"category": "NEW_CATEGORY", "new_category": "x", "confidence": "low"}' if len(p) % 4 == 2 else "no idea" for p in prompts]


@query("SELECT doc_id, CASE len(text) % 4 WHEN 0 THEN '01-trees' WHEN 1 THEN 'quiet-places' ELSE '99-general' END AS category, CASE WHEN len(text) % 4 < 2 THEN 'high' ELSE 'low' END AS confidence, len(text) % 4 < 3 AS model, len(text) % 4 = 1 AS new_category FROM documents")
def model_categories(spark, sf_dir):
    """Categories by a model, with the rule as fallback; a new one only if the model is sure."""
    d = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    said = V.answered(d, "key", "text", classify_stub)
    out = d.join(said, "key", "left").select("doc_id", V.classified(F.col("answer"), F.lit("99-general"), ["01-trees", "02-rivers"]).alias("c"))
    return out.select("doc_id", "c.category", "c.confidence", "c.model", "c.new_category")


def gate_stub(prompts: list[str]) -> list:
    return [f'{{"include": {"true" if len(p) % 2 else "false"}, "dimension": "new_case"}}' if len(p) % 3 else None for p in prompts]


@query("SELECT doc_id, category AS topic, CASE WHEN n % 3 = 0 THEN false ELSE n % 2 = 1 END AS include, CASE WHEN n % 3 = 0 THEN 'none' ELSE 'new_case' END AS dimension FROM (SELECT doc_id, category, len(min(title) OVER (PARTITION BY source_url, category)) AS n FROM items WHERE source_url <> '')", items=True)
def model_gate(spark, sf_dir):
    """Whether a card adds to a topic, asked once for each address and topic; no answer, no entry."""
    i = items(spark, sf_dir).where("source_url <> ''").withColumn("key", F.concat_ws("\u0001", "source_url", "category"))
    said = V.answered(i, "key", "title", gate_stub)
    return i.join(said, "key").select("doc_id", F.col("category").alias("topic"), V.judged(F.col("answer")).alias("j")).select("doc_id", "topic", "j.include", "j.dimension")


def relation_stub(prompts: list[str]) -> list:
    return [("RELATION: CONFLICT\nREASON: x" if p.endswith("0") else "RELATION: DUPLICATE" if p.endswith("5") else "unsure") for p in prompts]


@query("SELECT relation, count(*) AS n FROM (SELECT CASE vec_id % 10 WHEN 0 THEN 'CONFLICT' WHEN 5 THEN 'DUPLICATE' ELSE 'UNKNOWN' END AS relation FROM embeddings) GROUP BY relation")
def pair_relations(spark, sf_dir):
    """What a model says of pairs (here of each vector and the next)."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pair"), F.concat(F.lit("pair "), F.col("vec_id").cast("string")).alias("prompt"))
    return V.answered(p, "pair", "prompt", relation_stub).groupBy(V.relation(F.col("answer")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def length_vector(texts: list[str]) -> list:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, len(text)::DOUBLE AS a, (len(text) - len(replace(text, 'e', '')))::DOUBLE AS b FROM documents")
def embedded_texts(spark, sf_dir):
    """Vectors by a provider, in batches of 50, each text once."""
    d = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    v = V.answered(d, "key", "text", length_vector, "array<double>")
    return d.join(v, "key").select("doc_id", F.col("answer")[0].alias("a"), F.col("answer")[1].alias("b"))


def head_stub(prompts: list[str]) -> list:
    return [p[:20] for p in prompts]


@query(
    "SELECT doc_id, md5(CASE WHEN len(text) <= 2000 THEN text ELSE '（以下為長文件分段濃縮，原文 ' || len(text) || ' 字元）' || chr(10) || chr(10) || array_to_string(list_transform(range(0, least(12, ceil(len(text) / 2000.0)::BIGINT)), lambda i: trim(left(substr(text, i * 2000 + 1, 2000), 20))), chr(10) || chr(10)) || chr(10) || chr(10) || '--- 原文開頭 ---' || chr(10) || left(text, 800) END) AS text FROM documents"
)
def condensed_texts(spark, sf_dir):
    """Long texts as the summaries of their pieces, twelve at most, and their start. (The limit is the operator's.)"""
    c = V.condensed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", head_stub, 2000)
    return c.select("doc_id", F.md5("text").alias("text"))


def insight_stub(prompts: list[str]) -> list:
    import json

    return [json.dumps({"insights": [{"content": f"{len(p) % 5} things", "topic": "t"}, {"content": "same", "topic": "u"}]}) for p in prompts]


@query("SELECT conv_id, content, topic FROM (SELECT DISTINCT conv_id, (len(text) % 5) || ' things' AS content, 't' AS topic FROM conversations UNION SELECT conv_id, 'same', 'u' FROM conversations)")
def model_insights(spark, sf_dir):
    """What a model finds in each piece of a conversation, each finding once."""
    return V.insights(table(spark, sf_dir, "conversations").select("conv_id", "text"), "conv_id", "text", insight_stub)


def card_stub(prompts: list[str]) -> list:
    return ["SKIPPED: nothing here" if len(p) % 6 == 0 else "" if len(p) % 6 == 1 else f"# card of {len(p)}" for p in prompts]


@query("SELECT doc_id, CASE len(text) % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'done' END AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def worked_queue(spark, sf_dir):
    """Cards by a model for what has none; an answer that says SKIPPED is no card, an empty one a failure."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").withColumn("key", F.sha2("text", 256))
    j = d.join(V.answered(d, "key", "text", card_stub), "key")
    return j.select("doc_id", F.when(F.col("answer").rlike("^SKIPPED"), "skipped").when(F.coalesce("answer", F.lit("")) == "", "failed").otherwise("done").alias("status"))


@query("SELECT doc_id, CASE WHEN len(text) >= 2000 THEN 'full' WHEN doc_id % 3 = 0 THEN 'thread' WHEN doc_id % 3 = 1 AND len(text) >= 200 THEN 'fetched' ELSE 'link' END AS layer FROM documents")
def content_layers(spark, sf_dir):
    """The first layer of content that is long enough."""
    n = F.length("text")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.when(n >= 2000, "full"), F.when(F.col("doc_id") % 3 == 0, "thread"), F.when((F.col("doc_id") % 3 == 1) & (n >= 200), "fetched"), F.lit("link")).alias("layer"))
