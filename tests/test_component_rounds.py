"""Components: rounds move each edge once and only what is unsettled is joined; tasks are dealt by their rows."""

import numpy as np

from pointspark.operators import components


def plain(links):
    up = {}

    def top(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    return {n: top(n) for n in up}


def test_rounds_and_tasks(spark, monkeypatch):
    written, write = {}, components.materialize

    def kept(df, name):
        written.setdefault(name, []).append((df._jdf.queryExecution().optimizedPlan().toString(), write(df, name)))
        return written[name][-1][1]

    monkeypatch.setattr(components, "materialize", kept)
    monkeypatch.setattr(components, "discard", lambda *frames: None)
    monkeypatch.setattr(components, "DEALT", 20)
    rng = np.random.default_rng(5)
    line = rng.permutation(300).tolist()
    links = list(zip(line[:-1], line[1:], strict=True)) + [(1000 + i, 1000) for i in range(50)] + rng.integers(2000, 2400, (200, 2)).tolist()
    got = components.connected_components(spark.createDataFrame(links, "src long, dst long").repartition(8))
    assert {r["id"]: r["component"] for r in got.collect()} == plain([x for x in links if x[0] != x[1]])
    assert got.count() == got.select("id").distinct().count()
    assert all("Union" not in plan for plan, _ in written["cc-large"])  # not both directions of every edge
    plan, low = written["cc-low"][0]
    assert "RepartitionByExpression" in plan and low.count() > 4 * components.DEALT


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append((name, df._jdf.queryExecution().toString())) or write(df, name))
    rng = np.random.default_rng(7)
    line = rng.permutation(120).tolist()
    links = list(zip(line[:-1], line[1:], strict=True)) + rng.integers(200, 260, (40, 2)).tolist() + [(5, 5), (None, 3)]
    edges = spark.createDataFrame(links, "src long, dst long").repartition(8)
    want = plain([x for x in links if x[0] is not None and x[0] != x[1]])
    for dealt, rounds in ((1000, False), (20, True)):
        monkeypatch.setattr(components, "DEALT", dealt)
        written.clear()
        got = components.connected_components(edges).collect()
        assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
        assert ("cc-low" in dict(written)) == rounds
        if not rounds:
            assert [name for name, _ in written] == ["cc", "cc-joined"] and "Exchange" not in written[1][1]
    assert components.connected_components(edges.filter("src is null")).collect() == []
