"""Notes: index rows, paths, migration, key points, section documents and categories (S, D, F, K01, I09, I10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators import notes as N
from cartulary.plans.base import query
from cartulary.sources.records import note_sections, notes

_NL = "chr(10)"


def _x(pattern: str, of: str = "body") -> str:
    return f"trim(regexp_extract({of}, '{pattern}', 1))"


_TITLE = rf"""coalesce(nullif({_x(r'(?m)^title:\s*"?(.+?)"?\s*$')}, ''), nullif({_x(r'(?m)^#\s+(.+)$')}, ''), stem)"""
_CATEGORY = rf"""coalesce(nullif({_x(r'(?m)^category:\s*"?(.+?)"?\s*$')}, ''), 'general')"""
_LISTED = r"""list_filter(list_transform(string_split(regexp_extract(body, '(?m)^tags:\s*\[(.*?)\]\s*$', 1), ','), lambda t: trim(trim(t), '"''')), lambda t: t <> '')"""
_TAGS = rf"CASE WHEN len({_LISTED}) > 0 THEN {_LISTED} ELSE regexp_extract_all(body, '#([\p{{L}}\p{{N}}_\-]+)', 1) END"
_SUMMARY = rf"""coalesce(nullif({_x(r'##\s*📌\s*一句話摘要\s*\n+(.+)')}, ''), nullif(left({_x(r'##\s*📝\s*AI\s*濃縮\s*\n+(.+)')}, 200), ''), '')"""
_KIND = """CASE WHEN starts_with(stem, 'github_fork-') THEN 'github_fork' WHEN starts_with(stem, 'github_star-') THEN 'github_star' WHEN starts_with(stem, 'youtube-') THEN 'youtube' WHEN starts_with(stem, 'local-') THEN 'local-paper'
  WHEN regexp_matches(stem, '^[0-9]{15,20}$') THEN 'x-bookmark' ELSE 'local' END"""
_SOURCE = rf"""coalesce(nullif({_x(r'(?m)^source_type:\s*"?([^"\n]+)"?\s*$')}, ''), {_KIND})"""
_URL = rf"""coalesce(nullif(trim({_x(r'(?m)^source_url:\s*"?([^"\n]+)"?\s*$')}, '"'), ''), nullif(trim({_x(r'(?m)^original_url:\s*"?([^"\n]+)"?\s*$')}, '"'), ''), nullif(trim({_x(r'\*\*原始連結\*\*：\s*(\S+)')}, '"'), ''),
  nullif(trim({_x(r'(https://x\.com/\S+)')}, '"'), ''), nullif('https://x.com/i/status/' || {_x(r'(?m)^tweet_id:\s*"?([0-9]+)"?\s*$')}, 'https://x.com/i/status/'), '')"""
_ROWS = f"rows AS (SELECT path, stem, folder, lang, body, {_TITLE} AS title, {_CATEGORY} AS category, {_TAGS} AS tags, {_SUMMARY} AS summary, {_SOURCE} AS source_type, {_URL} AS source_url FROM notes)"


@query(
    f"SELECT path, title, category, array_to_string(tags, '|') AS tags, summary, source_type, source_url, contains(path, '/cards/') OR summary <> '' AS enriched, md5(title || {_NL} || category || {_NL} || array_to_string(tags, ' ') || {_NL} || summary || {_NL} || left(body, 2000)) AS searchable FROM rows",
    views=("notes",), ctes=_ROWS,
)
def index_build(spark, sf_dir):
    """A row of the index for each note, by the ladders of its fields. Its files come from read_markdown (S01) as well."""
    return N.index_rows(notes(spark, sf_dir)).select("path", "title", "category", F.array_join("tags", "|").alias("tags"), "summary", "source_type", "source_url", "enriched", F.md5("searchable").alias("searchable"))


@query(
    f"""SELECT path, CASE WHEN starts_with(rel, '/') THEN rel WHEN starts_with(rel, 'memory/') THEN '/w/' || rel WHEN starts_with(rel, 'cards/') THEN '/w/memory/' || rel ELSE '/w/memory/bookmarks/' || rel END AS canonical, {_KIND} AS of_index,
  CASE WHEN starts_with(stem, 'local-') THEN 'local-paper' WHEN starts_with(stem, 'legacy-') THEN 'x-bookmark' ELSE {_KIND} END AS of_migration, folder_name AS category FROM (
  SELECT path, stem, CASE doc_id % 4 WHEN 0 THEN substr(path, 8) WHEN 1 THEN path WHEN 2 THEN substr(path, 18) ELSE '/w/' || path END AS rel, string_split(path, '/')[-2] AS folder_name FROM notes)""",
    views=("notes",),
)
def note_paths(spark, sf_dir):
    """One path for four layouts, the source type of a name by two rules, the category of a folder."""
    rel = F.expr("CASE doc_id % 4 WHEN 0 THEN substr(path, 8) WHEN 1 THEN path WHEN 2 THEN substr(path, 18) ELSE '/w/' || path END")
    stem = F.col("stem")
    return notes(spark, sf_dir).select("path", N.canonical_path(rel).alias("canonical"), N.source_type_of_stem(stem).alias("of_index"), N.source_type_of_stem(stem, migrating=True).alias("of_migration"), F.element_at(F.split("path", "/"), -2).alias("category"))


@query(
    "SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' WHEN n.mtime = o.mtime AND n.size = o.size THEN 'same' ELSE 'changed' END AS state FROM (SELECT path, mtime, size FROM notes WHERE lang <> 'fr') n FULL JOIN (SELECT path, mtime + CASE WHEN source = 'src1' THEN 60 ELSE 0 END AS mtime, size + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS size FROM notes WHERE lang <> 'es') o ON n.path = o.path",
    views=("notes",),
)
def index_changes(spark, sf_dir):
    """Files against an index by whole seconds and size. What was there has no Spanish notes, what is there no French ones."""
    n = notes(spark, sf_dir)
    old = n.where("lang <> 'es'").selectExpr("path", "mtime + CASE WHEN source = 'src1' THEN 60 ELSE 0 END AS mtime", "size + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS size")
    return N.changed_files(n.where("lang <> 'fr'"), old)


_PLAIN = r"CASE WHEN regexp_matches(body, '\A\s*<think>') THEN regexp_replace(body, '\A\s*<think>(?s:.*?)</think>\s*', '') ELSE body END"


@query(
    rf"""SELECT path, md5(CASE WHEN has THEN '---' || {_NL} || rtrim(b2) || CASE WHEN open THEN '' ELSE {_NL} || 'sensitivity: public' END || {_NL} || '---' || {_NL} || rest ELSE plain END) AS text,
  array_to_string(list_filter([CASE WHEN regexp_matches(body, '\A\s*<think>') THEN 'stripped <think> block' END, CASE WHEN has THEN 'type: x-knowledge-card → knowledge-card' END, CASE WHEN has AND NOT typed THEN 'added source_type: ' || kind END,
    CASE WHEN has AND NOT open THEN 'added sensitivity: public' END, CASE WHEN NOT has THEN 'SKIP: no valid frontmatter after stripping' END], lambda x: x IS NOT NULL), '|') AS changes FROM (
  SELECT *, CASE WHEN typed THEN b1 ELSE replace(b1, 'type: knowledge-card', 'type: knowledge-card' || {_NL} || 'source_type: ' || kind) END AS b2 FROM (
  SELECT path, body, plain, starts_with(plain, '---') AS has, replace(block, 'type: x-knowledge-card', 'type: knowledge-card') AS b1, regexp_matches(block, '(?m)^source_type:') AS typed, regexp_matches(block, '(?m)^sensitivity:') AS open,
    regexp_extract(plain, '\A---\n(?s:.*?)\n---\s*\n?((?s:.*))', 1) AS rest, CASE WHEN starts_with(stem, 'local-') THEN 'local-paper' WHEN starts_with(stem, 'legacy-') THEN 'x-bookmark' ELSE {_KIND} END AS kind
  FROM (SELECT *, regexp_extract(plain, '\A---\n(?s:(.*?))\n---\s*\n?', 1) AS block FROM (SELECT *, {_PLAIN} AS plain FROM notes))))""",
    views=("notes",),
)
def note_migration(spark, sf_dir):
    """Front matter brought to today's form; what was filled in is listed."""
    m = notes(spark, sf_dir).select("path", N.migrated(F.col("body"), F.col("stem")).alias("m"))
    return m.select("path", F.md5("m.text").alias("text"), F.array_join("m.changes", "|").alias("changes"))


_POINTS = r"""list_slice(list_filter(list_transform(string_split(trim(regexp_replace(trim(regexp_extract(body, '(?s)##\s+[^\n]*三個重點[^\n]*\n(.+?)(?:\n##|\z)', 1)), '(?m)^[\-*•]\s*', '', 'g')), chr(10)), lambda x: trim(x)), lambda x: len(x) >= 10), 1, 5)"""


@query(
    f"SELECT path || '#kp' || unnest(range(len(points))) AS key, unnest(points) AS point FROM (SELECT path, {_POINTS} AS points FROM notes)",
    views=("notes",),
)
def key_points(spark, sf_dir):
    """The lines of the key-point sections, each of which gets a vector."""
    p = notes(spark, sf_dir).select("path", F.posexplode(N.key_point_list(F.col("body"))).alias("k", "point"))
    return p.select(F.concat(F.col("path"), F.lit("#kp"), F.col("k").cast("string")).alias("key"), "point")


_VSUM = r"""left(regexp_replace(trim(coalesce(nullif(regexp_extract(body, '(?s)##\s+[^\n]*一句話摘要\s*\n(.+?)(?:\n##|\z)', 1), ''), regexp_extract(body, '(?s)##\s+摘要\s*\n(.+?)(?:\n##|\z)', 1)), ' ' || chr(10)), '\s+', ' ', 'g'), 300)"""
_PTEXT = r"""trim(regexp_replace(trim(regexp_extract(body, '(?s)##\s+[^\n]*三個重點[^\n]*\n(.+?)(?:\n##|\z)', 1)), '(?m)^[\-*•]\s*', '', 'g'))"""


@query(
    f"SELECT path, md5(left(array_to_string(list_filter([trim(title), trim(CASE WHEN summary = '' THEN {_VSUM} ELSE summary END), {_PTEXT}], lambda x: x <> ''), '. '), 900)) AS text, CASE WHEN NOT regexp_matches(trim(title), '^[0-9]{{10,}}$') THEN trim(title) ELSE trim(title) END AS shown FROM rows",
    views=("notes",), ctes=_ROWS,
)
def card_texts(spark, sf_dir):
    """The text of a card's vector, with the summary that it falls back on; its shown title."""
    n = notes(spark, sf_dir)
    s, b = N.note_summary(F.col("body")), F.col("body")
    rows = n.select("path", N.note_title(b, F.col("stem")).alias("title"), F.when(s == "", N.vector_summary(b)).otherwise(s).alias("summary"), N.key_points(b).alias("points"))
    return rows.select("path", F.md5(N.card_text(F.col("title"), F.col("summary"), F.col("points"))).alias("text"), N.display_title(F.col("title"), F.lit("")).alias("shown"))


@query(
    "SELECT id, CASE WHEN trim(title) <> '' AND NOT regexp_matches(trim(title), '^[0-9]{10,}$') THEN trim(title) WHEN trim(summary) NOT IN ('', '待整理') AND s <> '' THEN s || '…' WHEN trim(title) <> '' THEN trim(title) ELSE '(untitled)' END AS shown FROM (SELECT *, trim(left(split_part(split_part(trim(summary), '。', 1), '.', 1), 60)) AS s FROM items)",
    items=True,
)
def display_titles(spark, sf_dir):
    """Numbers as titles give way to the summary's first sentence."""
    from cartulary.sources.records import items

    return items(spark, sf_dir).select("id", N.display_title(F.col("title"), F.col("summary")).alias("shown"))


@query(
    f"SELECT 'wiki/topics/' || stem || '.md#' || CASE WHEN heading = '' THEN 'intro' ELSE heading END AS key, left(md5(left(stem || ' — ' || heading || {_NL} || body, 4000)), 12) AS hash, count(*) AS n FROM sections WHERE len(body) >= 80 GROUP BY ALL",
    views=("sections",),
)
def section_documents(spark, sf_dir):
    """What section vectors are made of, by key and hash."""
    return N.section_documents(notes(spark, sf_dir)).groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT doc_id, heading, arg_min(body, section_no) AS body FROM sections WHERE heading <> '' GROUP BY doc_id, heading",
    views=("sections",),
)
def section_lookup(spark, sf_dir):
    """The text of a document's section by heading, the first of equals."""
    return note_sections(spark, sf_dir).where("heading <> ''").groupBy("doc_id", "heading").agg(F.min_by("body", "section_no").alias("body"))


#: Rules are configuration: the first that holds decides.
RULES = [("01-trees", ["zu", "baum"]), ("02-rivers", ["río", "ción", "tion"]), ("03-ways", ["src3", "way"])]
_SIGNAL = r"lower(title || chr(10) || array_to_string(tags, ', ') || chr(10) || left(regexp_replace(summary, '\s+', ' ', 'g'), 300))"
_BYRULE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_SIGNAL}, '{w}')" for w in words) + f" THEN '{c}'" for c, words in RULES) + " END"
_NEWCAT = f"coalesce({_BYRULE}, '99-general')"


@query(
    f"SELECT path, category, {_NEWCAT} AS chosen, regexp_replace({_NEWCAT}, '^[0-9]{{2}}-', '') AS canonical, {_BYRULE} IS NULL AS fallback FROM rows",
    views=("notes",), ctes=_ROWS,
)
def categories_by_rule(spark, sf_dir):
    """The first rule that the title, tags and summary hold; else the default."""
    rows = N.index_rows(notes(spark, sf_dir))
    found = N.rule_category(N.category_signal(F.col("title"), F.col("tags"), F.col("summary")), RULES)
    rows = rows.select("path", "category", found.alias("found")).withColumn("chosen", F.coalesce("found", F.lit("99-general")))
    return rows.select("path", "category", "chosen", N.canonical_category(F.col("chosen")).alias("canonical"), F.col("found").isNull().alias("fallback"))


@query(
    f"SELECT category AS before, {_NEWCAT} AS after, count(*) AS n FROM rows GROUP BY 1, 2",
    views=("notes",), ctes=_ROWS,
)
def category_changes(spark, sf_dir):
    """How the categories change."""
    return categories_by_rule(spark, sf_dir).groupBy(F.col("category").alias("before"), F.col("chosen").alias("after")).agg(F.count(F.lit(1)).alias("n"))


_INBOX = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(body), '{w}')" for w in words) + f" THEN '{c}'" for c, words in RULES) + " ELSE '99-general' END"


@query(f"SELECT path, 'memory/bookmarks/' || {_INBOX} || '/' || stem || '.md' AS moved FROM notes WHERE contains(path, '/inbox/')", views=("notes",))
def inbox_moves(spark, sf_dir):
    """Notes of the inbox to their category's folder, by their whole text."""
    n = notes(spark, sf_dir).where(F.contains("path", F.lit("/inbox/")))
    to = F.coalesce(N.rule_category(F.col("body"), RULES), F.lit("99-general"))
    return n.select("path", F.concat(F.lit("memory/bookmarks/"), to, F.lit("/"), F.col("stem"), F.lit(".md")).alias("moved"))


@query(
    rf"""SELECT path, md5(CASE WHEN regexp_matches(body, '(?m)^category:') THEN regexp_replace(body, '(?m)^category:[^\n]*$', 'category: 07-new') WHEN contains(body, '---' || {_NL})
  THEN left(body, strpos(body, '---' || {_NL}) + 3) || 'category: 07-new' || {_NL} || substr(body, strpos(body, '---' || {_NL}) + 4) ELSE body END) AS body FROM notes""",
    views=("notes",),
)
def applied_categories(spark, sf_dir):
    """a category written into the front matter, once."""
    return notes(spark, sf_dir).select("path", F.md5(N.with_category(F.col("body"), F.lit("07-new"))).alias("body"))


@query("SELECT category, min(k) AS first FROM (SELECT category, doc_id AS k FROM items UNION ALL SELECT lang || '-notes', doc_id + 1000000 FROM documents) GROUP BY category", items=True)
def taxonomy(spark, sf_dir):
    """Categories of the configuration, then of what was added, each once, in the order of their first."""
    from cartulary.sources.records import items, table

    added = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("-notes")).alias("category"), (F.col("doc_id") + 1_000_000).alias("k"))
    return items(spark, sf_dir).select("category", F.col("doc_id").alias("k")).unionByName(added).groupBy("category").agg(F.min("k").alias("first"))
