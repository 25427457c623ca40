"""Index items as a view of the table documents, and readers of semi-structured files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same expressions are valid in Spark SQL and DuckDB; {array} is how each writes a list.
_ITEMS = """
SELECT doc_id, doc_id::VARCHAR AS id,
  CASE doc_id % 10 WHEN 0 THEN lpad(doc_id::VARCHAR, 18, '1') WHEN 1 THEN 'tweet ' || lpad(doc_id::VARCHAR, 16, '2')
    WHEN 2 THEN '2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '-' || left(text, 10) ELSE left(split_part(text, '.', 1), 60) END AS title,
  CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN '待整理' ELSE left(text, 200) END AS summary,
  CASE WHEN doc_id % 13 = 0 THEN 'general' ELSE lang END AS category,
  {array} AS tags,
  CASE doc_id % 6 WHEN 0 THEN 'https://x.com/' || source || '/status/' || lpad((doc_id % 300)::VARCHAR, 18, '1') || '?s=1' WHEN 1 THEN 'https://x.com/bad'
    WHEN 2 THEN 'https://github.com/' || lang || '/' || (doc_id % 50)::VARCHAR WHEN 3 THEN '' WHEN 4 THEN 'https://example.org/p/' || (doc_id % 97)::VARCHAR ELSE 'ftp://x/' || doc_id::VARCHAR END AS source_url,
  'memory/' || CASE doc_id % 3 WHEN 0 THEN 'cards/' WHEN 1 THEN 'bookmarks/' ELSE 'cards/legacy-' END || lang || '/' || doc_id::VARCHAR || '.md' AS path,
  CASE doc_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'card' WHEN 2 THEN 'wiki' ELSE 'contrarian' END AS source_type,
  doc_id % 4 <> 0 AS enriched, doc_id % 17 = 0 AS excluded, left(text, 2000) AS searchable, 1700000000 + doc_id * 60 AS mtime,
  CASE doc_id % 5 WHEN 0 THEN 'team-a' WHEN 1 THEN 'team-b' END AS namespace, CASE doc_id % 9 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' END AS sensitivity
FROM documents"""
ITEMS_SQL = _ITEMS.format(array="[lang, source, 'q' || (doc_id % 5)::VARCHAR]")


#: Markdown notes, a note for each document: with and without front matter, thought blocks, headings, addresses and summaries. Valid in both.
NOTES_SQL = """
SELECT doc_id, lang, source, stem, folder, 'memory/' || folder || stem || '.md' AS path, head, 1700000000 + doc_id * 60 AS mtime, size,
  CASE WHEN doc_id % 12 = 5 THEN '<think>plan' || nl || 'more</think>' || nl ELSE '' END
  || CASE WHEN doc_id % 9 = 0 THEN '' ELSE '---' || nl || 'type: x-knowledge-card' || nl || CASE WHEN doc_id % 2 = 0 THEN 'title: "' || head || '"' ELSE 'title: ' || head END || nl
    || CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'category: ' || lang || '-notes' || nl END || CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'tags: [' || lang || ', "' || source || '"]' || nl END
    || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'source_url: "https://example.org/p/' || (doc_id % 97) || '"' || nl WHEN 2 THEN 'original_url: https://github.com/a/' || (doc_id % 50) || nl
      ELSE 'tweet_id: "' || lpad('' || doc_id, 16, '2') || '"' || nl END
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'source_type: card' || nl END || CASE doc_id % 10 WHEN 1 THEN 'sensitivity: public' || nl WHEN 2 THEN 'namespace: team-a' || nl ELSE '' END || '---' || nl END
  || CASE WHEN doc_id % 8 = 1 THEN '# ' || head || nl ELSE '' END || nl
  || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '## 📝 AI 濃縮' || nl || s1 || nl || s2 || nl WHEN 2 THEN '## 摘要' || nl || s1 || nl || s2 || nl ELSE '## 📌 一句話摘要' || nl || s1 || nl END
  || '## 三個重點' || nl || '- ' || s1 || nl || '* ' || s2 || nl || '- ' || lang || nl || CASE WHEN doc_id % 7 = 3 THEN '**原始連結**：https://x.com/u/status/' || lpad('' || doc_id, 17, '3') || nl ELSE '' END
  || '## Notes' || nl || txt || nl AS body
FROM (SELECT doc_id, lang, source, chr(10) AS nl, coalesce(text, '') AS txt, length(coalesce(text, '')) AS size, trim(replace(replace(left(split_part(coalesce(text, ''), '.', 1), 60), chr(10), ' '), '"', '')) AS head,
  trim(replace(split_part(coalesce(text, ''), '.', 2), chr(10), ' ')) AS s1, trim(replace(split_part(coalesce(text, ''), '.', 3), chr(10), ' ')) AS s2,
  CASE doc_id % 4 WHEN 0 THEN 'cards/' WHEN 1 THEN 'bookmarks/' || lang || '/' WHEN 2 THEN 'bookmarks/inbox/' ELSE 'cards/' END AS folder,
  CASE doc_id % 7 WHEN 0 THEN lpad('' || doc_id, 18, '1') WHEN 1 THEN 'github_star-' || doc_id WHEN 2 THEN 'github_fork-' || doc_id WHEN 3 THEN 'youtube-' || doc_id WHEN 4 THEN 'local-pmc' || doc_id WHEN 5 THEN 'legacy-' || doc_id ELSE 'note-' || doc_id END AS stem
  FROM documents)"""
#: Sections of notes at headings of one to three marks, without front matter.
SECTIONS_SQL = r"""
SELECT doc_id, path, stem, lang, source, section_no, trim(regexp_extract(part, '\A#{1,3} ([^\n]+)', 1)) AS heading, trim(regexp_replace(part, '\A#{1,3} [^\n]+\n?', ''), chr(10) || ' ' || chr(9) || chr(13)) AS body
FROM (SELECT doc_id, path, stem, lang, source, unnest(parts) AS part, unnest(range(len(parts))) AS section_no FROM (
  SELECT *, string_split(regexp_replace(regexp_replace(body, '\A---\n(?s:.*?)\n---\n', ''), '(?m)^(#{1,3} .+)$', chr(1) || '\1', 'g'), chr(1)) AS parts FROM notes))"""
#: Lines of memory files, from conversations: proposals, episode ids, system text and prose. Valid in both.
MEMORY_SQL = """
SELECT CASE conv_id % 4 WHEN 0 THEN 'memory/dreaming/' WHEN 1 THEN 'wiki/_staging/' ELSE 'memory/' END || '2024-01-' || lpad('' || (1 + conv_id % 28), 2, '0') || '.md' AS path, conv_id * 1000 + turn AS line_no, conv_id, turn,
  CASE turn % 4 WHEN 0 THEN '- Candidate: ' || split_part(replace(text, chr(10), ' '), ' ', 1) || CASE WHEN conv_id % 3 = 0 THEN '' ELSE ' episode_id: ep-' || (conv_id % 50) END
    WHEN 1 THEN '- **Topic: ' || split_part(replace(text, chr(10), ' '), ' ', 2) || '** session_id=s' || (conv_id % 9) WHEN 2 THEN 'Assistant: NO_REPLY ' || replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ') END AS line
FROM conversations"""
#: Messages: conversation turns, some with what asks for recall, greets or acknowledges. Valid in both.
MESSAGES_SQL = """
SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 16 WHEN 0 THEN '目前進度做到哪 ' || text WHEN 1 THEN '有沒有參考案例' WHEN 2 THEN 'ok' WHEN 3 THEN '早安' WHEN 4 THEN '值不值得比較 ' || text WHEN 5 THEN '之前怎麼處理的 roadmap 在哪' WHEN 6 THEN '哈哈哈'
  WHEN 7 THEN '怎麼設計 workflow ' || text WHEN 8 THEN '你好' WHEN 9 THEN '你好，知識庫怎麼規劃' WHEN 10 THEN '幫我翻譯 ' || text WHEN 11 THEN 'wiki' ELSE text END AS message FROM conversations"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index items: one row for each document."""
    text = _ITEMS.format(array="array(lang, source, 'q' || (doc_id % 5)::STRING)").replace("VARCHAR", "STRING").replace("FROM documents", "FROM {documents}")
    return spark.sql(text, documents=table(spark, sf_dir, "documents"))


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=table(spark, sf_dir, name))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown notes: one for each document."""
    return _view(spark, sf_dir, NOTES_SQL, "documents")


def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, stem, lang, source, section_no, heading, body) of all notes."""
    keys = ["doc_id", "path", "stem", "lang", "source"]
    plain = notes(spark, sf_dir).withColumn("body", without_front_matter(F.col("body")))
    return sections(plain, keys)


def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MEMORY_SQL, "conversations")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MESSAGES_SQL, "conversations")


def without_front_matter(body):
    return F.regexp_replace(body, r"\A---\n(?s:.*?)\n---\n", "")


def read_markdown(spark: SparkSession, root: str, skip: tuple[str, ...] = ("INDEX.md",)) -> DataFrame:
    """(path, body, mtime, size) of every Markdown file below root; not dot-files, indexes or inboxes."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    meta = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return meta.where(~name.startswith(".") & ~name.isin(*skip) & ~F.lower("path").contains("/inbox/")).dropDuplicates(["path"])


def read_index(spark: SparkSession, path: str, schema: str, most: int = 20 << 20) -> DataFrame:
    """Rows of an index file: an object with items, or a bare list. Broken files, and those of over `most` bytes, give no rows."""
    text = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= most)
    rows = F.coalesce(F.from_json("value", f"struct<items:array<struct<{schema}>>>").getField("items"), F.from_json("value", f"array<struct<{schema}>>"))
    return text.select(F.explode(rows).alias("i")).select("i.*")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a line that does not parse is left out."""
    lines = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return lines.where("_broken is null").drop("_broken")


def front_matter(body) -> F:
    """A map of the front matter's keys and values; null without one."""
    block = F.regexp_extract(body, r"\A---\n(?s:(.*?))\n---", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_]+:[ \t]*.*)$"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.split(p, ":", 2)[0].alias("k"), F.trim(F.regexp_replace(F.split(p, ":", 2)[1], "^\\s*[\"']?|[\"']?\\s*$", "")).alias("v")))
    kept = F.filter(entries, lambda e: e.v.isNotNull())
    last = F.map_from_entries(F.array_distinct(F.transform(kept, lambda e: F.struct(e.k, F.element_at(F.filter(kept, lambda x: x.k == e.k), -1).v.alias("v")))))
    return F.when(block != "", last)


def sections(files: DataFrame, keys: list[str] = ("path",), body: str = "body") -> DataFrame:
    """(keys, section_no, heading, body) at headings of one to three marks; text before the first has an empty heading."""
    marked = F.regexp_replace(body, r"(?m)^(#{1,3} .+)$", "\u0001$1")
    parts = files.select(*keys, F.posexplode(F.split(marked, "\u0001")).alias("section_no", "part"))
    heading = F.trim(F.regexp_extract("part", r"\A#{1,3} ([^\n]+)", 1))
    text = F.regexp_replace("part", r"\A#{1,3} [^\n]+\n?", "")
    return parts.select(*keys, F.col("section_no").cast("long"), heading.alias("heading"), F.btrim(text, F.lit("\n \t\r")).alias("body"))


def subtitle_text(vtt) -> F:
    """The spoken lines of a WebVTT file, each once, in order."""
    lines = F.transform(F.split(vtt, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.startswith("WEBVTT") & ~x.rlike("^(?:Kind|Language|NOTE)\\b|-->|^[0-9]+$"))
    return F.array_join(F.array_distinct(spoken), " ")


def article(xml) -> F:
    """Title, abstract, authors (five) and paragraphs of over 30 characters of an article in XML."""
    return F.struct(
        F.xpath_string(xml, F.lit("//article-title")).alias("title"),
        F.array_join(F.xpath(xml, F.lit("//abstract//p/text()")), " ").alias("abstract"),
        F.slice(F.xpath(xml, F.lit("//contrib//surname/text()")), 1, 5).alias("authors"),
        F.filter(F.xpath(xml, F.lit("//body//p/text()")), lambda p: F.length(p) > 30).alias("paragraphs"),
    )
