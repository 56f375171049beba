"""Suppression of tops whose radii differ a lot."""

import numpy as np
import pytest
from test_operators import values

from pointspark.operators import ranking


def frame(spark, rows):
    return spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(rows)], "cloud_id string, loc_id long, x double, y double, z double, radius double")


def greedy(rows, threshold, by):
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][by], i))
    kept = []
    for i in order:
        if all(np.hypot(rows[i][0] - rows[k][0], rows[i][1] - rows[k][1]) > (rows[i][3] + rows[k][3]) * threshold for k in kept):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("by_height", [True, False])
def test_mixed_radii_equal_the_greedy_order(spark, by_height):
    rng = np.random.default_rng(3)
    rows = np.column_stack((rng.random((300, 2)) * 60, rng.integers(0, 20, 300), 2.0 ** rng.integers(-4, 4, 300) * rng.uniform(1, 2, 300)))
    rows[0, 3], rows[1, 3], rows[2, 3] = 0.0, 1e-9, 40.0
    rows[2, 2] = -1
    for threshold in (0.5, 0.05):
        got = [i for (i,) in values(ranking.nms(frame(spark, rows), threshold, by_height), "loc_id")]
        assert got == greedy(rows, threshold, 2 if by_height else 3)


def test_one_wide_top_does_not_widen_the_cells_of_others(spark):
    rng = np.random.default_rng(4)
    rows = np.column_stack((rng.random((2000, 2)) * 400, rng.random(2000), np.full(2000, 0.5)))
    alone = ranking.nms_candidates(frame(spark, rows), 0.5, "z", "loc_id").count()
    with_wide = ranking.nms_candidates(frame(spark, [*rows, [200, 200, 50, 100.0]]), 0.5, "z", "loc_id").count()
    assert with_wide <= alone + len(rows) and with_wide < 5 * len(rows)


def test_tops_without_a_radius_stay(spark):
    df = spark.createDataFrame([("c", 1, 0.0, 0.0, 1.0, None), ("c", 2, 0.0, 0.0, 2.0, 1.0), ("c", 3, 0.1, 0.0, 1.0, 1.0)], "cloud_id string, loc_id long, x double, y double, z double, radius double")
    assert values(ranking.nms(df), "loc_id") == [(1,), (2,)]
    assert ranking.nms(df.limit(1)).count() == 1
