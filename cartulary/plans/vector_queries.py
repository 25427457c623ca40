"""Similarity search, pairs and gates over embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.functions.vectors import cosine, dot, is_vector, norm, unit
from cartulary.operators.nearest import nearest_vectors
from cartulary.plans.base import query
from cartulary.sources.records import table

_V = "embedding::DOUBLE[]"
#: Thresholds of these tables: their vectors are far less alike than a store's notes.
_PAIR, _NEAR = 0.3, 0.2


def _asked(e, *columns):
    """The query vectors, those whose id is divisible by 100."""
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), *columns, "embedding")


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform({_V}, lambda x: x * x)) / list_sum(list_transform({_V}, lambda x: x * x)), 6) AS unit_norm, len(embedding) = 64 AS valid FROM embeddings")
def vector_norms(spark, sf_dir):
    """F13, F14."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(dot(unit(v), unit(v)), 6).alias("unit_norm"), is_vector(v, 64).alias("valid"))


@query(f"SELECT q, vec_id, similarity FROM (SELECT a.vec_id AS q, b.vec_id, round(list_cosine_similarity(a.{_V}, b.{_V}), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.{_V}, b.{_V}), 6) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.{_V}, b.{_V}), 6) >= {_NEAR}) WHERE r <= 10")
def semantic_topk(spark, sf_dir):
    """The ten nearest vectors of each query above a floor."""
    e = table(spark, sf_dir, "embeddings")
    return nearest_vectors(_asked(e), e, 10, _NEAR)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.{_V}, b.{_V}), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.{_V}, b.{_V}), 6) >= {_PAIR} ORDER BY 3 DESC, 1, 2 LIMIT 10")
def conflict_pairs(spark, sf_dir):
    """The ten most alike pairs of a query vector and another. (The limit is the operator's; op5 links all rows.)"""
    e = table(spark, sf_dir, "embeddings")
    pairs = nearest_vectors(_asked(e), e, 10, _PAIR)  # the ten best of all are among the ten best of each
    return pairs.select(F.col("q").alias("a"), F.col("vec_id").alias("b"), "similarity").orderBy(F.desc("similarity"), "a", "b").limit(10)


@query(f"SELECT label, count(*) AS n, round(max(list_cosine_similarity({_V}, qv::DOUBLE[])), 6) AS best, arg_min(vec_id, (-round(list_cosine_similarity({_V}, qv::DOUBLE[]), 6), vec_id)) AS vec_id FROM embeddings, (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) GROUP BY label")
def best_per_topic(spark, sf_dir):
    """The most alike vector of each topic."""
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("qv")))
    s = F.round(cosine(F.col("embedding"), F.col("qv")), 6)
    return e.join(q).withColumn("s", s).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("best"), F.max_by("vec_id", F.struct("s", (-F.col("vec_id")).alias("o"))).alias("vec_id"))


_ABSORB = f"""SELECT c.vec_id, c.label, max(CASE WHEN s.vec_id % 4 <> 0 THEN round(list_cosine_similarity(c.{_V}, s.{_V}), 6) END) AS relevance, max(CASE WHEN s.vec_id % 4 = 0 THEN round(list_cosine_similarity(c.{_V}, s.{_V}), 6) END) AS redundancy
  FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) c JOIN (SELECT * FROM embeddings WHERE vec_id % 100 <> 0) s ON c.label = s.label GROUP BY c.vec_id, c.label"""


def _absorbed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    kind = F.col("kind")
    rows = e.where("vec_id % 100 <> 0").select("label", (F.col("vec_id") % 4 == 0).alias("kind"), "vec_id", "embedding")
    asked = _asked(e, "label", F.explode(F.array(F.lit(True), F.lit(False))).alias("kind"))
    best = nearest_vectors(asked, rows, 1, by=("label", "kind"))
    return best.groupBy(F.col("q").alias("vec_id"), "label").agg(F.max(F.when(~kind, F.col("similarity"))).alias("relevance"), F.max(F.when(kind, F.col("similarity"))).alias("redundancy"))


@query(f"SELECT * EXCLUDE r, CASE WHEN relevance IS NULL THEN 'skip' WHEN relevance < 0.1 THEN 'off_topic' WHEN redundancy > 0.25 THEN 'redundant' WHEN r > 25 THEN 'over_cap' ELSE 'allow' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY relevance DESC NULLS LAST, vec_id) AS r FROM ({_ABSORB}))")
def absorb_gate(spark, sf_dir, relevance: float = 0.1, redundancy: float = 0.25, cap: int = 25):
    """Relevance to a topic's sections, redundancy with what it has, a cap on each topic. Candidates are the query set; the cap is the operator's."""
    w = Window.partitionBy("label").orderBy(F.col("relevance").desc_nulls_last(), "vec_id")
    out = _absorbed(spark, sf_dir).withColumn("r", F.row_number().over(w))
    decision = F.when(F.col("relevance").isNull(), "skip").when(F.col("relevance") < relevance, "off_topic").when(F.col("redundancy") > redundancy, "redundant").when(F.col("r") > cap, "over_cap").otherwise("allow")
    return out.select("vec_id", "label", "relevance", "redundancy", decision.alias("decision"))


@query(f"SELECT label, count(*) AS candidates, count(*) FILTER (relevance < 0.1) AS off_topic, count(*) FILTER (relevance >= 0.1 AND redundancy > 0.25) AS redundant FROM ({_ABSORB}) GROUP BY ROLLUP (label)")
def absorb_summary(spark, sf_dir):
    """By topic, with the grand total."""
    c = F.col
    return _absorbed(spark, sf_dir).rollup("label").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(c("relevance") < 0.1).alias("off_topic"), F.count_if((c("relevance") >= 0.1) & (c("redundancy") > 0.25)).alias("redundant"))
