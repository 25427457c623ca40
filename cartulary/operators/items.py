"""Identity, keep-best and first-seen deduplication of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions.predicates import low_signal, valid_source_url
from cartulary.functions.text import clean_summary, status_id, stem, text_or_empty


def identity(path: Column, url: Column, record_id: Column) -> Column:
    """x: status number (of the file's name or the address), else url:, id:, stem:, path:."""
    name, u, i = stem(path), text_or_empty(url), text_or_empty(record_id)
    return (
        F.when(name.rlike("^[0-9]{15,20}$"), F.concat(F.lit("x:"), name))
        .when((u != "") & (status_id(u) != ""), F.concat(F.lit("x:"), status_id(u)))
        .when(u != "", F.concat(F.lit("url:"), u))
        .when(i != "", F.concat(F.lit("id:"), i))
        .when(name != "", F.concat(F.lit("stem:"), name))
        .otherwise(F.concat(F.lit("path:"), path))
    )


def _human(title: Column) -> Column:
    return ~F.lower(text_or_empty(title)).rlike(r"^(?:tweet\s+)?[0-9]{15,20}$")


def index_score() -> Column:
    """Which of several rows of one record an index keeps: the highest."""
    summary, title = text_or_empty(F.col("summary")), text_or_empty(F.col("title"))
    in_cards = F.startswith(F.col("path"), F.lit("memory/cards/"))
    parts = [~F.col("excluded"), F.col("enriched"), in_cards, F.length(summary) >= 18, _human(title)]
    sizes = [F.least(F.length(summary), F.lit(300)), F.least(F.length(title), F.lit(120)), F.col("mtime")]
    return F.struct(*[p.cast("int").alias(f"p{k}") for k, p in enumerate(parts)], *[x.alias(f"s{k}") for k, x in enumerate(sizes)])


def canonical_score() -> Column:
    """Which row of one address is the canonical one."""
    summary, title = clean_summary(F.col("summary")), text_or_empty(F.col("title"))
    parts = [~F.col("excluded"), F.col("enriched"), F.startswith(F.col("path"), F.lit("memory/cards/")), ~low_signal(F.col("summary")) & (F.length(summary) >= 18), (title != "") & _human(title), ~F.contains(F.col("path"), F.lit("legacy-"))]
    return F.struct(*[p.cast("int").alias(f"p{k}") for k, p in enumerate(parts)], F.least(F.length(summary), F.lit(300)).alias("s0"), F.least(F.length(title), F.lit(120)).alias("s1"))


def keep_best(items: DataFrame, key: Column, score: Column, order: str) -> DataFrame:
    """The row of the highest score of each key (ties: the first by order), as one grouped maximum: no sort, and partial sums before the shuffle."""
    best = F.max_by(F.struct(*[F.col(c) for c in items.columns]), F.struct(score.alias("s"), (-F.col(order)).alias("o")))
    return items.groupBy(key.alias("_key")).agg(best.alias("_row"), F.count(F.lit(1)).alias("group_size")).select("_row.*", "group_size")


def mark_duplicates(items: DataFrame, order: str) -> DataFrame:
    """Rows that share a valid address: all but the best are excluded, with the path of the one kept."""
    w = Window.partitionBy("_url")
    out = items.withColumn("_url", F.when(valid_source_url(F.col("source_url")), F.trim("source_url")))
    out = out.where("_url is not null").withColumn("_rank", F.row_number().over(w.orderBy(canonical_score().desc(), order)))
    out = out.withColumn("_kept", F.first("path").over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.select(*items.columns, F.col("_rank").cast("long").alias("dup_rank"), F.when(F.col("_rank") > 1, F.col("_kept")).alias("duplicate_of"))


def first_seen(rows: DataFrame, key: Column, order: str, ident: str) -> DataFrame:
    """Each row with the id of the first row of its key, if that is another."""
    first = rows.groupBy(key.alias("_key")).agg(F.min_by(ident, order).alias("_first"))
    return rows.withColumn("_key", key).join(first, "_key").select(*rows.columns, F.when(F.col("_first") != F.col(ident), F.col("_first")).alias("first_id"))


def fuzzy_lookup(asked: DataFrame, known: DataFrame, ident: str, prefix: str = "memory/") -> DataFrame:
    """(ident, step, found) of asked (ident, key) among known (key): the key itself, it without the prefix, with the prefix or .md, its first point vector (key#...), or the first of its file's name. Equi-joins, the first step that finds something."""
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    key = F.col("key")
    tries = [(1, "exact", key), (2, "prefix", F.regexp_replace(key, f"^{prefix}", "")), *[(3, "alternate", x) for x in (F.concat(F.lit(prefix), key), F.concat(F.lit(prefix), key, F.lit(".md")), F.concat(key, F.lit(".md")))]]
    whole = asked.select(ident, F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("step"), x.alias("try")) for p, s, x in tries])))
    base = F.element_at(F.split(key, "#"), 1)
    k = known.select(key.alias("found"), base.alias("base"), name(base).alias("name"), F.contains(key, F.lit("#")).alias("point"))
    hits = whole.join(k, F.col("try") == F.col("found")).select(ident, "p", "step", "found")
    points = k.where("point").groupBy("base").agg(F.min("found").alias("found"))
    names = k.groupBy("name").agg(F.min("found").alias("found"))
    hits = hits.unionByName(asked.join(points, key == F.col("base")).select(ident, F.lit(4).alias("p"), F.lit("point").alias("step"), "found"))
    hits = hits.unionByName(asked.withColumn("name", name(key)).join(names, "name").select(ident, F.lit(5).alias("p"), F.lit("name").alias("step"), "found"))
    return hits.groupBy(ident).agg(F.min_by(F.struct("step", "found"), F.struct("p", "found")).alias("b")).select(ident, "b.step", "b.found")
