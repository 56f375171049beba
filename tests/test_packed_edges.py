"""Edges of a cut graph are packed before rounds move them; a way of no length does not lead back."""

from test_operators import edges, values

from pointspark.operators import graph


def test_rounds_move_packed_edges(spark, monkeypatch):
    n, written, write = 400, {}, graph.materialize

    def kept(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(graph, "materialize", kept)
    line = [(i, i + 1, 1.0) for i in range(n)] + [(i + 1, i, 1.0) for i in range(n)]
    src = spark.createDataFrame([("c", 0, 0)], "cloud_id string, node long, target long")
    at = spark.createDataFrame([("c", i, float(i), 0.0) for i in range(n + 1)], "cloud_id string, node long, x double, y double")
    assert dict(values(graph.shortest_paths(edges(spark, line), src, places=at, most=200), "node", "dist")) == {i: float(i) for i in range(n + 1)}
    assert not any("src" in df.columns for df in written.values())
    assert written["packed-edges"].count() <= 8  # two tiles hold nodes, in four tasks; the edges are 800


def test_no_way_back_over_a_border(spark):
    links = [(4, 3, 1.0), (3, 4, 1.0), (3, 1, 0.0), (1, 3, 0.0)]
    src = spark.createDataFrame([("c", 4, 4)], "cloud_id string, node long, target long")
    assert values(graph.shortest_paths(edges(spark, links), src, most=2), "node", "dist", "prev") == [(1, 1.0, 3), (3, 1.0, 4), (4, 0.0, None)]
