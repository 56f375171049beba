"""Radii constrained along paths, and the nearest of neighbours whose distances tie."""

import math
import random

from pointspark.operators import ranking
from pointspark.plans import catalog


def plain(radii):
    out = []
    for r in radii:
        up = [1.1 * out[-1]] if out and out[-1] is not None else []
        out.append(min([*up, *([] if r is None else [r])], default=None, key=lambda v: (math.isnan(v), v)))
    return out


def test_constrained_radii_equal_the_fold_for_any_blocks(spark):
    draw = random.Random(5)
    paths = {p: [draw.choice([None, draw.random(), 10 * draw.random(), 100.0]) for _ in range(n)] for p, n in enumerate((1, 3, 40, 200))}
    paths[4] = [1e-9, *[5.0] * 300]
    paths[5] = [None, None, 2.0, float("nan"), 0.0, 3.0, 4.0]
    rows = [("c", p, i, 9 * i, r) for p, radii in paths.items() for i, r in enumerate(radii)]
    nodes = spark.createDataFrame(rows, "cloud_id string, path_id int, seq int, node_id long, radius double")
    for block in (7, 4096):
        got = ranking.constrain_radii(nodes, block=block)
        assert got.columns == nodes.columns
        at = {(r["path_id"], r["seq"]): r["radius"] for r in got.collect()}
        assert at == {(p, i): r for p, radii in paths.items() for i, r in enumerate(plain(radii))}


def test_constrain_radii_gathers_no_path(spark, sf):
    plan = catalog.queries()["constrain_radii"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "concat" not in plan


def test_topk_of_unequal_squares_with_equal_roots(spark):
    a = 2.0
    b = math.nextafter(a, 3.0)
    assert a < b and math.sqrt(a) == math.sqrt(b)
    pairs = spark.createDataFrame([("c", 1, 9, math.sqrt(a), 1), ("c", 1, 2, math.sqrt(b), 2)], "cloud_id string, src long, dst long, dist double, rank int")
    assert [r["dst"] for r in ranking.topk_neighbours(pairs, 1).collect()] == [9]

