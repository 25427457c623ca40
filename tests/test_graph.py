"""Betweenness against a plain count of shortest paths."""

import random
from collections import deque
from itertools import permutations

import pytest

from cartulary.operators.graph import betweenness


def _plain(edges):
    """The definition: of all ordered pairs of other nodes, the mean share of their shortest paths that lead through a node."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far = {}
    for s in near:
        dist, ways, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            v = todo.popleft()
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        far[s] = dist, ways
    total = dict.fromkeys(near, 0.0)
    for s, t in permutations(near, 2):
        dist, ways = far[s]
        for v in near:
            if t in dist and v in dist and v not in (s, t) and t in far[v][0] and dist[v] + far[v][0][t] == dist[t]:
                total[v] += ways[v] * far[v][1][t] / ways[t]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in total.items()}


def _random(n, m, seed):
    r = random.Random(seed)
    return [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize(
    "edges",
    [
        _random(16, 22, 1),
        _random(12, 40, 2),
        [(f"p{i}", f"p{i + 1}") for i in range(9)] + [("q1", "q2"), ("q2", "q3")],
        [("hub", f"leaf{i}") for i in range(30)] + [("hub", "leaf3"), ("leaf3", "hub"), ("leaf4", "leaf4")],
        [("a", "b"), (None, "b"), ("c", None), ("d", "d")],
    ],
    ids=["sparse", "dense", "two parts", "hub", "one edge"],
)
def test_betweenness_equals_its_definition(spark, edges):
    got = {r.node: r.centrality for r in betweenness(spark.createDataFrame(edges, "a string, b string").repartition(3)).collect()}
    want = _plain(edges)
    assert set(got) == set(want)
    assert all(abs(got[v] - x) < 2e-6 for v, x in want.items())


def test_no_edges_no_nodes(spark):
    assert betweenness(spark.createDataFrame([], "a string, b string")).collect() == []
