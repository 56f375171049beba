"""Shortest paths by tiles: against a plain search, whatever the tiles, in rounds that grow with tiles and not with edges."""

import heapq

import numpy as np
import pytest
from test_operators import edges, values

from pointspark.operators import graph


def plain(links, sources, limit=None):
    out, heap = {}, [(0.0, t, n) for n, t in sources]
    heapq.heapify(heap)
    while heap:
        d, t, n = heapq.heappop(heap)
        if n not in out and (limit is None or d <= limit):
            out[n] = (d, t)
            for a, b, w in links:
                if a == n:
                    heapq.heappush(heap, (d + w, t, b))
    return out


def counted(monkeypatch):
    rounds, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (rounds.append(name), write(df, name))[1])
    return rounds


@pytest.mark.parametrize("places", [False, True])
def test_tiles_change_nothing(spark, monkeypatch, places):
    rng = np.random.default_rng(2)
    x = rng.random((150, 2)) * [10, 4]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    links = [(i, int(j), round(float(d[i, j]), 6)) for i in range(150) for j in np.argsort(d[i])[1:5]]
    sources = [(3, 3), (77, 5), (120, 5)]
    src = spark.createDataFrame([("c", *s) for s in sources], "cloud_id string, node long, target long")
    at = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(x)], "cloud_id string, node long, x double, y double") if places else None
    for limit in (None, 2.0):
        got = [{r["node"]: (r["dist"], r["target"]) for r in graph.shortest_paths(edges(spark, links), src, limit, at, most).collect()} for most in (10**6, 90)]
        assert got[0] == got[1] == plain(links, sources, limit)
    rows = graph.shortest_paths(edges(spark, links), src, None, at, 90).collect()
    by = {r["node"]: r for r in rows}
    weight = {(a, b): w for a, b, w in links}
    assert all(r["prev"] is None if r["dist"] == 0 else by[r["prev"]]["dist"] + weight[r["prev"], r["node"]] == r["dist"] for r in rows)


def test_rounds_grow_with_tiles_and_not_with_edges(spark, monkeypatch):
    n = 400
    line = [(i, i + 1, 1.0) for i in range(n)] + [(i + 1, i, 1.0) for i in range(n)]
    src = spark.createDataFrame([("c", 0, 0)], "cloud_id string, node long, target long")
    rounds = counted(monkeypatch)
    for most, expected in ((10**6, 1), (200, 4)):
        rounds.clear()
        got = dict(values(graph.shortest_paths(edges(spark, line), src, most=most), "node", "dist"))
        assert got == {i: float(i) for i in range(n + 1)}
        assert rounds.count("relaxed") <= expected + 1


def test_stem_by_doubling(spark, monkeypatch):
    n = 100
    links = [(i, i + 1, 1.0) for i in range(n)] + [(40, 200, 1.0)]
    segments = spark.createDataFrame([("c", i, 0.0, 0.0, float(i), 1) for i in [*range(n + 1), 200]], "cloud_id string, segment long, x double, y double, z double, is_stem int")
    rounds = counted(monkeypatch)
    assert values(graph.find_stem(segments, edges(spark, links)), "seq", "node_id") == [(i, i) for i in range(n + 1)]
    assert rounds.count("stem") <= 10


def test_nothing_to_reach(spark):
    src = spark.createDataFrame([("c", 9, 1)], "cloud_id string, node long, target long")
    assert values(graph.shortest_paths(edges(spark, [(1, 2, 1.0)]), src), "node", "dist") == [(9, 0.0)]
    assert graph.shortest_paths(edges(spark, [(1, 2, 1.0)]), src.limit(0)).count() == 0
