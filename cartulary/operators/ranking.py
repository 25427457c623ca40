"""Keyword, vector, hybrid and cross-layer ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.config import DEFAULT, Settings
from cartulary.functions.text import clean_summary, let, text_or_empty
from cartulary.functions.vectors import cosine


def _sum(tokens: list[str], points: list[tuple[Column, int]]) -> Column:
    total = F.lit(0)
    for t in tokens:
        for field, n in points:
            total = total + F.when(F.contains(field, F.lit(t)), n).otherwise(0)
    return total


def fields() -> dict[str, Column]:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return {"title": low("title"), "tags": F.lower(F.array_join("tags", " ")), "category": low("category"), "summary": low("summary"), "blob": low("searchable")}


def search_score(terms: list[str]) -> Column:
    """All terms must be in the blob; 6, 5, 3, 2 and 1 points for a term in title, tags, category, summary and blob. Null if one is missing."""
    f = fields()
    every = F.lit(True)
    for t in terms:
        every = every & F.contains(f["blob"], F.lit(t))
    return F.when(every, _sum(terms, [(f["title"], 6), (f["tags"], 5), (f["category"], 3), (f["summary"], 2), (f["blob"], 1)]))


def card_score(tokens: list[str], query: str) -> Column:
    """8, 6, 4, 3 and 1 points for a token in title, tags, category, summary and blob; 8 for the whole query; 2 and 1 for having summary and tags."""
    f = fields()
    score = _sum(tokens, [(f["title"], 8), (f["tags"], 6), (f["category"], 4), (f["summary"], 3), (f["blob"], 1)])
    score = score + F.when(F.lit(bool(query)) & F.contains(f["blob"], F.lit(query)), 8).otherwise(0)
    return score + F.when(F.coalesce("summary", F.lit("")) != "", 2).otherwise(0) + F.when(F.size("tags") > 0, 1).otherwise(0)


# fixed values: the points of these ladders
def title_quality(title: Column, s: Settings = DEFAULT) -> Column:
    t = text_or_empty(title)
    low = F.lower(t)
    return (
        F.when(t == "", -0.12).when(low.isin(*s.low_signal_titles), -0.15).when(low.rlike(r"^tweet\s+[0-9]{15,20}$"), -0.14).when(t.rlike("^[0-9]{15,20}$"), -0.16)
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}-") & (F.length(t) < 42), -0.08).when(F.length(t) < 8, -0.05).otherwise(0.03)
    )


def summary_quality(summary: Column, s: Settings = DEFAULT) -> Column:
    return let(clean_summary(summary), lambda c: F.when(c == "", -0.08).when(c.isin(*s.low_signal_summaries), -0.12).when(F.length(c) < 12, -0.05).when(F.length(c) >= 40, 0.05).otherwise(0.02))


def source_quality(source: Column, url: Column, title: Column, s: Settings = DEFAULT) -> Column:
    src, u = F.lower(text_or_empty(source)), F.lower(text_or_empty(url))
    plus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return (
        plus(src == "youtube", 0.05) + plus(F.startswith(u, F.lit("https://")), 0.05) + plus(F.contains(u, F.lit("github.com")), 0.05) + plus(u.rlike(r"x\.com/|twitter\.com/"), 0.02)
        + plus(F.lower(text_or_empty(title)).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}-"), -0.08) + plus(src.isin(*s.low_signal_sources) & (u == ""), -0.03)
    )


def category_penalty(category: Column, s: Settings = DEFAULT) -> Column:
    return F.when(F.lower(text_or_empty(category)).isin(*s.generic_categories), -0.08).otherwise(0.0)


def provenance_penalty(*texts: Column, s: Settings = DEFAULT) -> Column:
    return F.when(F.concat_ws(" ", *texts).rlike(r"self-derived|\(memory/[0-9]{4}-[0-9]{2}-[0-9]{2}"), s.self_derived_penalty).otherwise(0.0)


def adjustments() -> Column:
    total = summary_quality(F.col("summary")) + title_quality(F.col("title")) + source_quality(F.col("source_type"), F.col("source_url"), F.col("title")) + category_penalty(F.col("category")) + provenance_penalty(F.col("summary"))
    return F.round(total, 4)


def unified(score: Column, layer: Column, s: Settings = DEFAULT) -> tuple[Column, Column]:
    """(relevance, unified score): score / (score + the layer's anchor), then by the layer's weight."""
    known = lambda values, rest: F.coalesce(F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), layer), F.lit(rest))
    rel = F.when(score <= 0, F.lit(0.0)).otherwise(score / (score + known(s.anchors, s.fallback_anchor)))
    return F.round(rel, 4), F.round(rel * known(s.weights, s.fallback_weight), 4)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows: one bounded heap a task, merged; never a full sort."""
    return df.orderBy(*order).limit(n)


def top_in_group(df: DataFrame, group: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group; Spark cuts groups in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def nearest(vectors: DataFrame, query: list[float], n: int, floor: float, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """Exact cosine top n above a floor, in one scan."""
    sim = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return top(vectors.withColumn("similarity", F.round(sim, 6)).where(F.col("similarity") >= floor), n, F.desc("similarity"), ident)


def rank_fusion(lists: list[DataFrame], ident: str, k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of lists (ident, rank)."""
    both = lists[0].select(ident, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(ident, "rank"))
    return both.groupBy(ident).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 8).alias("rrf"), F.count(F.lit(1)).cast("long").alias("lists"))
