"""Sources that are written, read back and compared: packed vectors, files of days, traces and topic pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.operators.topics import topic_page
from cartulary.plans.base import query
from cartulary.sources import dated, packed, store
from cartulary.sources.records import memory_lines, notes, table


@query("SELECT how, vec_id, len(embedding) AS numbers, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS squares FROM (SELECT 'whole' AS how, vec_id, embedding FROM embeddings UNION ALL SELECT 'key', vec_id, embedding FROM embeddings WHERE vec_id % 50 = 7)")
def packed_vectors(spark, sf_dir):
    """Vectors packed with a header, read back whole by ranges, and some by their keys."""
    v = table(spark, sf_dir, "embeddings")
    folder = store.new_folder(spark, "packed")
    packed.write_packed(v, folder, dims=64)
    whole = packed.read_packed(spark, folder, dims=64).select(F.lit("whole").alias("how"), "key", "vector")
    some = packed.lookup_packed(v.where("vec_id % 50 = 7"), folder, "vec_id", dims=64).select(F.lit("key").alias("how"), "key", "vector")
    d = F.col("vector").cast("array<double>")
    return whole.unionByName(some).select("how", F.col("key").alias("vec_id"), F.size("vector").cast("long").alias("numbers"), F.get(d, 0).alias("first"), F.element_at(d, -1).alias("last"), F.round(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"))


@query("SELECT day, count(*) AS n, sum(line_no)::BIGINT AS numbers, md5(string_agg(line, chr(10) ORDER BY line_no)) AS text FROM (SELECT DATE '2024-01-01' + (conv_id % 28)::INT AS day, line_no, line FROM memory) WHERE day >= DATE '2024-01-15' GROUP BY day", views=("memory",))
def recent_days(spark, sf_dir):
    """Memory lines written as files of days under two roots and read for the last fourteen days; the earlier folders are not read."""
    lines = memory_lines(spark, sf_dir).select(F.expr("date_add(DATE'2024-01-01', cast(conv_id % 28 as int))").alias("day"), "line_no", "line", "conv_id")
    folder = store.new_folder(spark, "days")
    dated.write_days(lines.where("conv_id % 2 = 0"), f"{folder}/a")
    dated.write_days(lines.where("conv_id % 2 = 1"), f"{folder}/b")
    back = dated.daily_lines(spark, [f"{folder}/a", f"{folder}/b", f"{folder}/a/"], F.lit("2024-01-15").cast("date"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    return back.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("numbers"), F.md5(text).alias("text"))


@query(
    """SELECT episode, snapshots, n, md5(text) AS text FROM (SELECT conv_id, 'ep-' || conv_id AS episode, max(turn) AS last FROM conversations WHERE conv_id % 20 <> 0 GROUP BY conv_id HAVING max(turn) >= 1) e
  JOIN (SELECT conv_id, count(*) AS n, count(*) FILTER (turn > 0) AS snapshots, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id) USING (conv_id)"""
)
def trace_snapshots(spark, sf_dir):
    """Each conversation as traces of JSON lines, a snapshot after each turn but the first, some of another schema or broken; of each episode the newest is read."""
    c = table(spark, sf_dir, "conversations")
    earlier = c.select("conv_id", F.col("turn").alias("t"), "role", "text")
    shots = c.where("turn > 0").select("conv_id", "turn").join(earlier, "conv_id").where("t <= turn").groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("messages"))
    at = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    trace = F.to_json(F.struct(F.when(F.col("conv_id") % 20 == 0, "other").otherwise("trace.v1").alias("schema"), F.concat(F.lit("ep-"), F.col("conv_id").cast("string")).alias("episode"), at.alias("at"), "messages"))
    folder = store.new_folder(spark, "traces")
    store.write(shots.select(trace.alias("value")).unionByName(shots.limit(1).select(F.lit('{"schema": "trace.v1", "episode": ').alias("value"))), folder, kind="text")
    newest = dated.newest_snapshots(spark, folder, "trace.v1", F.lit("2023-01-01").cast("timestamp"))
    told = F.array_join(F.transform("messages", lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n")
    many = shots.groupBy(F.concat(F.lit("ep-"), F.col("conv_id").cast("string")).alias("episode")).agg(F.count(F.lit(1)).alias("snapshots"))
    return newest.join(many, "episode").select("episode", "snapshots", F.size("messages").cast("long").alias("n"), F.md5(told).alias("text"))


_MARKS = "'[*`]', '', 'g'"


@query(
    rf"""SELECT doc_id, title, left(description, 200) AS description, section_no, heading, len(items) AS items, md5(CASE WHEN len(items) > 0 THEN items[1] ELSE left(regexp_replace(content, {_MARKS}), 300) END) AS first FROM (
  SELECT doc_id, CASE WHEN fm <> '' THEN fm WHEN h <> '' THEN h ELSE stem END AS title, coalesce(description, '') AS description, i - 2 AS section_no, trim(split_part(part, chr(10), 1)) AS heading, trim(substr(part, len(split_part(part, chr(10), 1)) + 2), chr(10) || ' ') AS content,
    list_transform(regexp_extract_all(trim(substr(part, len(split_part(part, chr(10), 1)) + 2), chr(10) || ' '), '\*\*([^*\n]{{4,80}})\*\*\n+([^\n#*][^\n]*)'), lambda x: x)[1:6] AS items FROM (
    SELECT doc_id, stem, trim(regexp_extract(page, '(?m)^title:\s*(.+)$', 1)) AS fm, trim(regexp_extract(page, '(?m)^#{{1,2}}\s+(.+)$', 1)) AS h, regexp_replace(list_filter(list_transform(string_split_regex(body, '\n{{2,}}'), lambda p: trim(p, chr(10) || ' ')), lambda p: p <> '' AND NOT starts_with(p, '#'))[1], {_MARKS}) AS description,
      unnest(parts) AS part, unnest(range(len(parts))) + 1 AS i FROM (SELECT *, string_split(regexp_replace(chr(10) || body, '\n##\s+', chr(1), 'g'), chr(1)) AS parts FROM (SELECT doc_id, stem, page, regexp_replace(page, '\A---(?s:.*?)---\n', '') AS body FROM (
        SELECT doc_id, stem, body || chr(10) || '**Point ' || doc_id || '**' || chr(10) || lang || ' text' || chr(10) || '**' || source || ' more**' || chr(10) || chr(10) || 'again' || chr(10) AS page FROM notes)))) WHERE i > 1)""".replace("{{", "{").replace("}}", "}"),
    views=("notes",),
)
def topic_pages(spark, sf_dir):
    """Topic pages to title, description and sections with their bold headlines, or their plain text."""
    page = F.concat(F.col("body"), F.lit("\n**Point "), F.col("doc_id").cast("string"), F.lit("**\n"), F.col("lang"), F.lit(" text\n**"), F.col("source"), F.lit(" more**\n\nagain\n"))
    p = notes(spark, sf_dir).select("doc_id", topic_page(page, F.col("stem")).alias("p")).select("doc_id", "p.title", "p.description", F.posexplode("p.sections").alias("section_no", "s"))
    return p.select("doc_id", "title", "description", F.col("section_no").cast("long").alias("section_no"), F.col("s.heading").alias("heading"), F.size("s.items").cast("long").alias("items"), F.md5(F.when(F.size("s.items") > 0, F.get(F.col("s.items"), 0)).otherwise(F.col("s.plain"))).alias("first"))
