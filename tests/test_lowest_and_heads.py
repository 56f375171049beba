"""The lowest points around peaks and the heads near second nodes, on dense and repeated places."""

import numpy as np

from pointspark.operators import spatial

AT = "cloud_id string, pid long, x double, y double, z double"


def _clouds(spark, n_points, n_others, seed):
    draw = np.random.default_rng(seed)
    p = np.round(draw.uniform(-3, 3, (n_points, 3)), 1)
    q = np.round(draw.uniform(-3.5, 3.5, (n_others, 3)), 1)
    p[: n_points // 4] = p[0]
    frame = lambda x: spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(x)], AT)
    return p, q, frame(p), frame(q)


def test_ball_lowest_equals_brute_force(spark):
    p, q, points, peaks = _clouds(spark, 600, 60, 1)
    for radius, deepest in ((0.2, 40), (0.5, 40), (2.0, 40), (0.5, 0)):
        want = {}
        for i, c in enumerate(q):
            d2 = (p[:, 0] - c[0]) * (p[:, 0] - c[0]) + (p[:, 1] - c[1]) * (p[:, 1] - c[1])
            own = [(p[j, 2], j) for j in np.flatnonzero(d2 <= radius * radius)]
            if own:
                z, j = min(own)
                want[i] = (p[j, 0], p[j, 1], z)
        got = spatial.ball_lowest(peaks.withColumnRenamed("pid", "peak_id"), points, radius, deepest=deepest)
        assert got.columns == ["cloud_id", "peak_id", "x", "y", "z"]
        assert {r["peak_id"]: (r["x"], r["y"], r["z"]) for r in got.collect()} == want


def test_head_nn_equals_brute_force_and_makes_no_pairs(spark):
    p, q, seconds, heads = _clouds(spark, 300, 80, 2)
    q[:20] = p[0]
    heads = spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(q)], AT)
    want = set()
    for i, c in enumerate(p):
        d2 = (c[0] - q[:, 0]) ** 2 + (c[1] - q[:, 1]) ** 2 + (c[2] - q[:, 2]) ** 2
        near = sorted((d2[j], j) for j in np.flatnonzero((d2 > 0) & (d2 < 2.25)))[:4]
        want |= {(i, j, k + 1) for k, (_, j) in enumerate(near)}
    got = spatial.head_nn(seconds.withColumnRenamed("pid", "node_id"), heads.withColumnRenamed("pid", "node_id"), 1.5)
    assert {(r["src"], r["dst"], r["rank"]) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
