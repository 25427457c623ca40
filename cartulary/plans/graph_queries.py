"""The graph of topics, tags and cards (G, J17, J18, K13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartulary.operators.graph import betweenness
from cartulary.plans.base import query
from cartulary.sources import store
from cartulary.sources.records import items

_EDGES = """sampled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS rn FROM items WHERE NOT excluded) WHERE rn <= 150 ORDER BY rn, category LIMIT 250),
concepts AS (SELECT tag FROM (SELECT unnest(tags) AS tag FROM items WHERE NOT excluded) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 25),
edges AS (SELECT 'card:' || id AS a, 'topic:' || category AS b FROM sampled UNION SELECT 'card:' || id, 'tag:' || tag FROM (SELECT id, unnest(tags) AS tag FROM sampled) WHERE tag IN (SELECT tag FROM concepts))"""
_LEVELS = 8
#: Shortest paths by levels: (s, t, number of paths) at each distance.
_PATHS = (
    "both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), nodes AS (SELECT DISTINCT a AS s FROM both_ways), l0 AS (SELECT s, s AS t, 1::DOUBLE AS n FROM nodes), "
    + ", ".join(
        f"l{k} AS (SELECT s, b AS t, sum(n) AS n FROM l{k - 1} JOIN both_ways ON t = a WHERE (s, b) NOT IN (SELECT (s, t) FROM ({' UNION ALL '.join(f'SELECT s, t FROM l{j}' for j in range(k))})) GROUP BY s, b)"
        for k in range(1, _LEVELS)
    )
    + ", paths AS ("
    + " UNION ALL ".join(f"SELECT s, t, {k} AS d, n FROM l{k}" for k in range(_LEVELS))
    + """), between AS (SELECT x.t AS node, round(sum(x.n * y.n / z.n) / ((SELECT count(*) FROM nodes) - 1) / ((SELECT count(*) FROM nodes) - 2), 6) AS centrality FROM paths x JOIN paths y ON x.t = y.s JOIN paths z ON x.s = z.s AND y.t = z.t WHERE x.s <> x.t AND y.s <> y.t AND x.d + y.d = z.d GROUP BY x.t),
central AS (SELECT s AS node, coalesce(centrality, 0.0) AS centrality FROM nodes LEFT JOIN between ON s = node)"""
)


def _edges(spark, sf_dir):
    """A report's graph shows a balanced sample of cards, 150 of a category and 250 in all, their topics, and the 25 most frequent tags."""
    w = Window.partitionBy("category").orderBy("doc_id")
    all_items = items(spark, sf_dir).where("not excluded")
    concepts = all_items.select(F.explode("tags").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(25).select("t")
    i = all_items.withColumn("rn", F.row_number().over(w)).where("rn <= 150").orderBy("rn", "category").limit(250)
    topics = i.select(F.concat(F.lit("card:"), "id").alias("a"), F.concat(F.lit("topic:"), "category").alias("b"))
    tags = i.select(F.concat(F.lit("card:"), "id").alias("a"), F.explode("tags").alias("t")).join(F.broadcast(concepts), "t").select("a", F.concat(F.lit("tag:"), "t").alias("b"))  # 25 rows
    return topics.union(tags).distinct()


@query(f"{_EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node", items="more")
def node_degrees(spark, sf_dir):
    """G01, G02, J17."""
    e = _edges(spark, sf_dir)
    return e.select(F.col("a").alias("node")).union(e.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"{_EDGES} SELECT x.b AS bridge, count(DISTINCT y.b) AS topics FROM edges x JOIN edges y ON x.a = y.a WHERE x.b LIKE 'tag:%' AND y.b LIKE 'topic:%' GROUP BY x.b", items="more")
def bridge_topics(spark, sf_dir):
    """Tags with the topics that they reach by cards."""
    e = _edges(spark, sf_dir)
    t = e.where("b like 'topic:%'").select("a", F.col("b").alias("topic"))
    return e.where("b like 'tag:%'").join(t, "a").groupBy(F.col("b").alias("bridge")).agg(F.countDistinct("topic").alias("topics"))


@query(f"{_EDGES}, {_PATHS} SELECT node, centrality FROM central", items="more")
def centrality(spark, sf_dir):
    """Betweenness of the graph's nodes."""
    return betweenness(_edges(spark, sf_dir))


@query(
    f"""{_EDGES}, {_PATHS} SELECT node, centrality, degree, coalesce(topics, '') AS topics FROM (SELECT * FROM central WHERE centrality > 0 AND NOT starts_with(node, 'card:') ORDER BY centrality DESC, node LIMIT 8) JOIN (SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY a) USING (node)
  LEFT JOIN (SELECT node, array_to_string(list_slice(list(topic ORDER BY topic), 1, 4), ',') AS topics FROM (SELECT DISTINCT x.b AS node, y.b AS topic FROM edges x JOIN edges y ON x.a = y.a WHERE y.b LIKE 'topic:%' AND x.b <> y.b) GROUP BY node) USING (node)""",
    items="more",
)
def bridges(spark, sf_dir):
    """The eight concepts and topics that connect most, with their degree and four of the topics that they reach. (The limits are the report's.)"""
    e = _edges(spark, sf_dir)
    best = betweenness(e).where("centrality > 0 and node not like 'card:%'").orderBy(F.desc("centrality"), "node").limit(8)
    degree = e.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    t = e.where("b like 'topic:%'").select("a", F.col("b").alias("topic"))
    near = e.join(t, "a").where("b <> topic").groupBy(F.col("b").alias("node")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("topic")), 1, 4), ",").alias("topics"))
    return best.join(degree, "node").join(near, "node", "left").select("node", "centrality", "degree", F.coalesce("topics", F.lit("")).alias("topics"))


@query(f"{_EDGES} SELECT kind, count(*) AS nodes, (SELECT count(*) FROM edges) AS edges FROM (SELECT DISTINCT split_part(node, ':', 1) AS kind, node FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges)) GROUP BY kind", items="more")
def graph_written(spark, sf_dir):
    """The graph in JSON, read back, its nodes by kind."""
    e = _edges(spark, sf_dir)
    back = store.write(e, store.new_folder(spark, "graph"), kind="json")
    nodes = back.select(F.col("a").alias("node")).union(back.select("b")).distinct()
    kinds = nodes.groupBy(F.split("node", ":")[0].alias("kind")).agg(F.count(F.lit(1)).alias("nodes"))
    return kinds.crossJoin(back.agg(F.count(F.lit(1)).alias("edges")))  # one row
