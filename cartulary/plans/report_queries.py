"""Aggregates (A) and checks over items, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.operators import evidence as E
from cartulary.plans.base import query
from cartulary.sources.records import items, table


@query("SELECT category, count(*) AS total, count(*) FILTER (NOT excluded) AS active, count(*) FILTER (excluded) AS excluded_rows, count(*) FILTER (mtime >= 1700030000) AS recent FROM items GROUP BY ROLLUP (category)", items=True)
def item_status(spark, sf_dir):
    """Totals by category, and in all."""
    return items(spark, sf_dir).rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("excluded")).alias("active"), F.count_if("excluded").alias("excluded_rows"), F.count_if(F.col("mtime") >= 1700030000).alias("recent"))


@query("SELECT lang, count(*) AS topics, sum(len(regexp_extract_all(text, chr(10))))::BIGINT AS lines, max(n_chars) AS longest, round(avg(n_chars), 4)::DOUBLE AS mean FROM documents GROUP BY lang")
def topic_stats(spark, sf_dir):
    """Lines and lengths by language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("topics"), F.sum(F.regexp_count("text", F.lit("\n")).cast("long")).alias("lines"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("SELECT quality, toxic, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share, (100 * count(*) // sum(count(*)) OVER ())::BIGINT AS whole FROM labels GROUP BY quality, toxic")
def decision_rates(spark, sf_dir):
    """Counts and rates of decisions."""
    c = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return c.select("quality", "toxic", "n", F.round(100.0 * F.col("n") / total, 4).alias("share"), F.floor(100 * F.col("n") / total).cast("long").alias("whole"))


@query("SELECT kind, name, n, round(n::DOUBLE / max(n) OVER (PARTITION BY kind), 4) AS weight FROM (SELECT 'category' AS kind, category AS name, count(*) AS n FROM items GROUP BY category UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM items) GROUP BY tag UNION ALL SELECT 'source', source_type, count(*) FROM items GROUP BY source_type)", items=True)
def topic_profile(spark, sf_dir):
    """Counts and weights of categories, tags and sources."""
    i = items(spark, sf_dir)
    one = lambda kind, df, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    rows = one("category", i, "category").unionByName(one("tag", i.select(F.explode("tags").alias("tag")), "tag")).unionByName(one("source", i, "source_type"))
    return rows.withColumn("weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy("kind")), 4))


@query("SELECT user_id, count(*) AS considered, count(*) FILTER (event_type = 'error' AND value > 100) AS injected, round(max(value), 6)::DOUBLE AS best FROM events GROUP BY user_id HAVING count(*) >= 5 AND count(*) FILTER (event_type = 'error' AND value > 100) = 0 ORDER BY 2 DESC, 4, 1 LIMIT 100")
def cold_knowledge(spark, sf_dir):
    """Often considered, never used."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("considered"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("injected"), F.round(F.max("value"), 6).alias("best"))
    return g.where("considered >= 5 and injected = 0").orderBy(F.desc("considered"), "best", "user_id").limit(100)


@query("SELECT title_key, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, trim(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}_\\s]', '', 'g')) AS title_key FROM items) WHERE title_key <> '' GROUP BY title_key HAVING count(*) > 1", items=True)
def title_duplicates(spark, sf_dir):
    """A15."""
    return items(spark, sf_dir).select("doc_id", T.normal_title(F.col("title")).alias("title_key")).where("title_key <> ''").groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (summary <> '') / count(*), 4) AS coverage, count(*) FILTER (enriched) AS enriched_rows, count(*) FILTER (summary <> '') * 100 >= 70 * count(*) AS covered FROM items", items=True)
def index_freshness(spark, sf_dir):
    """Coverage and thresholds."""
    has = F.count_if(F.col("summary") != "")
    n = F.count(F.lit(1))
    return items(spark, sf_dir).agg(n.alias("n"), F.round(100.0 * has / n, 4).alias("coverage"), F.count_if("enriched").alias("enriched_rows"), (has * 100 >= 70 * n).alias("covered"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 25")
def top_words(spark, sf_dir):
    """The twenty-five most frequent words."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, min(len(text)) AS shortest, max(len(text)) AS longest FROM conversations GROUP BY role")
def review_stats(spark, sf_dir):
    """Counts and ranges by status."""
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


_ROUNDS = "SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, conv_id FROM conversations"


@query(f"SELECT key, count(*) AS evidence, count(DISTINCT conv_id) AS episodes, round(least(0.99, 0.35 + 0.18 * least(count(DISTINCT conv_id), 4) + 0.06 * least(count(*), 5)), 2)::DOUBLE AS confidence FROM ({_ROUNDS}) GROUP BY key")
def conversation_evidence(spark, sf_dir):
    """A08 over conversations: a conversation is an episode."""
    rows = table(spark, sf_dir, "conversations").select(T.normal_statement(F.col("text")).alias("key"), "conv_id")
    g = rows.groupBy("key").agg(F.count(F.lit(1)).alias("evidence"), F.countDistinct("conv_id").alias("episodes"))
    return g.withColumn("confidence", E.confidence(F.col("episodes"), F.col("evidence")).cast("double"))


@query("SELECT c.category, c.n FROM (SELECT category, count(*) AS n FROM items GROUP BY category) c WHERE c.n >= 5 AND c.category NOT IN ('en', 'de')", items=True)
def topic_gaps(spark, sf_dir):
    """Categories of five items and more that no topic covers."""
    known = spark.sql("SELECT * FROM VALUES ('en'), ('de') v(category)")
    return items(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").join(known, "category", "left_anti")


@query("SELECT id, datediff('day', make_date(2023, 11, 14), make_timestamp(mtime * 1000000)::DATE)::BIGINT AS age, datediff('day', make_date(2023, 11, 14), make_timestamp(mtime * 1000000)::DATE) > 0 AS stale, CASE WHEN regexp_matches(title, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN left(title, 10) END AS title_date FROM items", items=True)
def ages(spark, sf_dir):
    """Days since a date; a date in a title."""
    day = F.to_date(F.timestamp_seconds("mtime"))
    age = F.datediff(day, F.lit("2023-11-14").cast("date")).cast("long")
    found = F.when(F.col("title").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left("title", F.lit(10)))
    return items(spark, sf_dir).select("id", age.alias("age"), (age > 0).alias("stale"), found.alias("title_date"))


@query("SELECT s.source, s.n AS topics, r.n AS recalls FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) s LEFT JOIN (SELECT 'src' || (user_id % 20)::VARCHAR AS source, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) r ON s.source = r.source")
def recall_coverage(spark, sf_dir):
    """Topics with their recalls."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("topics"))
    r = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source")).agg(F.count(F.lit(1)).alias("recalls"))
    return s.join(r, "source", "left")


@query("SELECT id, CASE WHEN regexp_matches(lower(title || ' ' || array_to_string(tags, ' ') || ' ' || summary), 'the') THEN 'english' WHEN regexp_matches(lower(title || ' ' || array_to_string(tags, ' ') || ' ' || summary), 'der|und') THEN 'german' ELSE 'other' END AS category FROM items", items=True)
def rule_categories(spark, sf_dir):
    """Ordered keyword rules, the first that hits."""
    text = F.lower(F.concat_ws(" ", "title", F.array_join("tags", " "), "summary"))
    return items(spark, sf_dir).select("id", F.when(text.rlike("the"), "english").when(text.rlike("der|und"), "german").otherwise("other").alias("category"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, sf_dir):
    """A grouped aggregate over the largest table, as an engine check."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2)::DOUBLE AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def orders_by_nation(spark, sf_dir):
    """A four-way join, as an engine check."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).cast("double").alias("price"))
