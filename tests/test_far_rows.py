"""Nearest neighbours where a few rows are far from all others, or many are at one place."""

import numpy as np
import pytest

from pointspark.operators import spatial


@pytest.mark.parametrize("axes", ["xyz", "xy"])
def test_far_rows_and_many_at_one_place(spark, monkeypatch, axes):
    monkeypatch.setattr(spatial, "MOST", 800)
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=(1500, 3)) * 10, [[5000, 5000, 5000]], np.repeat([[3.0, 3.0, 3.0]], 600, axis=0), [[-90, 0, 0]]))
    df = spark.createDataFrame([("c", i, *map(float, v)) for i, v in enumerate(x)], "cloud_id string, pid long, x double, y double, z double").repartition(4)
    fullest, led, in_tiles, descend = [], [], spatial._in_tiles, spatial._descend
    monkeypatch.setattr(spatial, "_in_tiles", lambda todo, other, k, cell, *a, **b: (fullest.append(spatial._fullest(other, cell, axes)), in_tiles(todo, other, k, cell, *a, **b))[1])
    monkeypatch.setattr(spatial, "_descend", lambda todo, *a, **b: (led.append(todo.count()), descend(todo, *a, **b))[1])
    got = {(r["src"], r["rank"]): r["dst"] for r in spatial.knn(df, 4, axes).collect()}
    assert len(got) == 4 * len(x)
    assert max(fullest) <= 800 // 4  # no tile holds more, whatever lies far outside
    assert led and 1 <= led[0] < len(x)
    for q in range(0, len(x), 7) if len(x) else ():
        d = ((x[:, : len(axes)] - x[q, : len(axes)]) ** 2).sum(axis=1)
        near = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == near
    for q in (1500, 2101):
        assert all((q, r) in got for r in (1, 2, 3, 4))


def test_two_clouds_and_other_rows(spark, monkeypatch):
    """Queries far from a dense right side, in two clouds of different extent."""
    monkeypatch.setattr(spatial, "MOST", 100)
    rng = np.random.default_rng(1)
    right = {c: rng.random((400, 3)) * s for c, s in (("a", 1.0), ("b", 50.0))}
    left = {c: np.concatenate((rng.random((20, 3)) * s, rng.normal(size=(20, 3)) * 40 * s)) for c, s in (("a", 1.0), ("b", 50.0))}
    frame = lambda rows, i: spark.createDataFrame([(c, n, *map(float, v)) for c, vs in rows.items() for n, v in enumerate(vs)], f"cloud_id string, {i} long, x double, y double, z double")
    got = {(r["cloud_id"], r["src"]): (r["dst"], r["dist"]) for r in spatial.knn(frame(left, "pid"), 1, "xyz", frame(right, "loc_id"), right_id="loc_id").collect()}
    assert len(got) == 80
    for (c, q), (dst, dist) in got.items():
        d = np.sqrt(((right[c] - left[c][q]) ** 2).sum(axis=1))
        assert dst == d.argmin() and dist == pytest.approx(d.min())
