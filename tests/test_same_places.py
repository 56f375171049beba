"""Neighbour searches among rows that share places."""

import numpy as np
import pytest

from pointspark.operators import spatial


def brute(q, q_ids, c, c_ids, k, cell, same, bound, apart):
    out = []
    for n, (x, i) in enumerate(zip(q, q_ids, strict=True)):
        d2 = ((c - x) ** 2).sum(axis=1)
        ok = (d2 < min(cell, bound) ** 2) & ~(same & (c_ids == i)) & ~(apart & (d2 == 0))
        best = sorted(zip(d2[ok].tolist(), c_ids[ok].tolist(), strict=True))[:k]
        out += [(n, i, d, r) for r, (d, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("twice", [False, True])
@pytest.mark.parametrize("spread", [3, 50])
def test_as_brute_force(same, apart, twice, spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(0, spread, (400, 2)).astype(float)
    ids = rng.permutation(400)
    if twice:
        ids[:40] = ids[40:80]
    q, q_ids = (c, ids) if same else (rng.integers(0, spread, (300, 2)).astype(float), np.arange(300))
    got = spatial.nearest(q, q_ids, c, ids, 4, 2.5, same, 2.5, apart)
    assert sorted((int(n), int(i), float(d), int(r)) for n, i, d, r in zip(*got, strict=True)) == sorted(brute(q, q_ids, c, ids, 4, 2.5, same, 2.5, apart))


def test_a_place_is_searched_once(monkeypatch):
    met, plain = [], spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda q, q_ids, c, *rest: met.append((len(q), len(c))) or plain(q, q_ids, c, *rest))
    x = np.repeat(np.arange(20.0), 500)[:, None] * np.ones(2)
    got = spatial.nearest(x, np.arange(10_000), x, np.arange(10_000), 4, 3.0, True)
    assert met == [(20, 100)] and len(got[0]) == 40_000


def test_rows_at_one_place_are_thinned(spark):
    rows = spark.range(6000).selectExpr("'a' AS cloud_id", "id", "double(id % 10) AS x", "double(id % 5) AS y")
    assert spatial._thinned(rows, "xy", 2).count() == 20
    assert spatial._thinned(rows.withColumn("x", rows["id"] * 1.0), "xy", 2).count() == 6000


def test_clusters_of_few_places(spark, monkeypatch):
    written, plain = {}, spatial.materialize
    monkeypatch.setattr(spatial, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    p = spark.range(4000).selectExpr("'a' AS cloud_id", "id AS pid", "id % 2 AS label", "double(id % 8) AS x", "0D AS y", "0D AS z")
    got = spatial.cluster_min_distance(p, spark.sql("SELECT 'a' AS cloud_id, 0L AS src, 1L AS dst")).collect()
    assert [tuple(r) for r in got] == [("a", 0, 1, 1.0, 1.0)] and written["cluster-points"].count() == 8


def test_far_rows_of_one_cloud_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MOST", 100)
    rng = np.random.default_rng(1)
    at = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((300, 2)))]
    far = [("a", 1000 + i, 50.0 + i, -3.0) for i in range(40)]
    p = spark.createDataFrame(far, "cloud_id string, pid long, x double, y double")
    t = spark.createDataFrame(at, "cloud_id string, loc_id long, x double, y double")
    got = {r["src"]: r["dst"] for r in spatial.nn_xy(p, t).collect()}
    assert got == {i: min(at, key=lambda r: ((r[2] - x) ** 2 + (r[3] - y) ** 2, r[1]))[1] for _, i, x, y in far}
