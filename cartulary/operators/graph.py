"""Edges, and betweenness by levels of a breadth-first search from all sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.sources import store


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge between different nodes, once. Edges with a null end go."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, centrality): normalised betweenness of every node with an edge, exact and undirected, to six places.

    Brandes' sums as joins. Going out, a level holds (source, node, paths): the nodes reached from the
    level before that are in neither of the last two levels, with the number of shortest paths to
    them. Coming back, each node's share goes to its neighbours one level nearer the source, in
    proportion to their paths. Levels are staged, so a lost executor costs a read and both sides of
    a join are plain shuffles, which Spark can split where a node has very many neighbours. There are
    two jobs a level, as many levels as the longest shortest path, and a row for each source and
    node reached, as the exact measure needs. Graphs of fewer than three nodes have centrality 0.
    """
    spark = edges.sparkSession
    folder = store.new_folder(spark, "betweenness")
    both = store.write(undirected(edges), f"{folder}/edges")
    nodes = store.write(both.select(F.col("a").alias("node")).distinct(), f"{folder}/nodes")
    levels = [store.write(nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")), f"{folder}/level-0")]
    while True:
        seen = reduce(DataFrame.unionByName, [x.select("s", "v") for x in levels[-2:]])
        reached = levels[-1].join(both, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        level = store.write(reached.join(seen, ["s", "v"], "left_anti"), f"{folder}/level-{len(levels)}")
        if level.isEmpty():
            break
        levels.append(level)
    shares = []
    below = None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].withColumn("share", F.lit(0.0)) if below is None else levels[k].join(below, ["s", "v"], "left").na.fill(0.0, ["share"])
        here = store.write(here, f"{folder}/share-{k}")
        shares.append(here.select("v", "share"))
        part = here.select("s", F.col("v").alias("w"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        nearer = part.join(both, F.col("w") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("part").alias("part"))
        below = nearer.join(levels[k - 1], ["s", "v"]).select("s", "v", (F.col("part") * F.col("paths")).alias("share"))
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    totals = reduce(DataFrame.unionByName, shares, nodes.select(F.col("node").alias("v"), F.lit(0.0).alias("share")))
    return totals.groupBy(F.col("v").alias("node")).agg(F.round(F.sum("share") * scale, 6).alias("centrality"))
