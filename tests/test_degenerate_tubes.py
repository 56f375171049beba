"""Tubes of paths that stand still or run against the x axis."""

import math

from pyspark.sql import functions as F

from pointspark.operators import qsm
from pointspark.plans import catalog

SCHEMA = "cloud_id string, path_id int, i int, x double, y double, z double, radius double"


def test_a_ring_without_a_direction_is_nan(spark):
    rows = [("c", 0, 0, 0.0, 0.0, 0.0, 0.3), ("c", 0, 1, 0.0, 0.0, 1.0, 0.3), ("c", 0, 2, 0.0, 0.0, 1.0, 0.3), ("c", 1, 0, 1.0, 0.0, 0.0, 0.3), ("c", 1, 1, 0.0, 0.0, 0.0, 0.3)]
    v, f = qsm.tube_mesh(spark.createDataFrame(rows, SCHEMA), 4)
    bad = {(r["path_id"], r["vid"]) for r in v.collect() if any(math.isnan(r[c]) for c in "xyz")}
    assert bad == {(0, n) for n in range(4, 12)} | {(1, n) for n in range(8)}
    kept, left = qsm.drop_nan_vertices(v, f)
    assert sorted(r["vid"] for r in kept.collect()) == [0, 1, 2, 3]
    assert {r["path_id"] for r in left.collect()} == {0}


def test_holes_are_every_eleventh_vertex_only(spark):
    rows = [("c", 7 * i, float(i // 2), 0.0, float(i // 2), 0.3, 0) for i in range(6)]  # points in pairs at one place
    p = spark.createDataFrame(rows, "cloud_id string, pid long, x double, y double, z double, radius double, itc long")
    v, _ = catalog._holed(p)
    assert {r["vid"] for r in v.filter(F.isnan("x") | F.isnan("y") | F.isnan("z")).collect()} == {n for n in range(48) if n % 11 == 0}
