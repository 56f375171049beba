"""Gap filling over triangles: against all triples of cells, on planes and quadratics, and for several tile sizes."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointspark.operators import interpolation, raster


def plain_triangle(occupied, cell, reach, low):
    """The triangle of least lifted height around ``cell`` by trying all triples."""
    p = np.array([q for q in np.argwhere(occupied) if np.abs(q - cell).max() <= reach + 1])
    if len(p) < 3:
        return None
    d = (p - cell).astype(float)
    h = (d * d).sum(axis=1) + interpolation.raised(p[:, 0] + low[0], p[:, 1] + low[1])
    t = np.array(list(combinations(range(len(p)), 3)))
    m = np.concatenate((d[t].transpose(0, 2, 1), np.ones((len(t), 1, 3))), axis=1)
    flat = np.abs(np.linalg.det(m)) < 1e-9
    m[flat] = np.eye(3)
    for side in (1, -1):
        w = np.linalg.solve(m, np.array([side * 0.618e-6, side * 1e-6, 1])[:, None])[..., 0]
        cost = np.where(flat | (w.min(axis=1) < 0), np.inf, (w * h[t]).sum(axis=1))
        if np.isfinite(cost).any():
            tri = p[t[cost.argmin()]]
            return tri if interpolation._reaches(tri, cell, reach, low) else None
    return None


@pytest.mark.parametrize("seed", range(6))
def test_triangles_are_the_lowest_of_all(seed):
    rng = np.random.default_rng(seed)
    reach, low = int(rng.integers(2, 6)), (int(rng.integers(-50, 1000)), int(rng.integers(-50, 1000)))
    occupied, value = rng.random((9, 9)) < rng.choice([0.15, 0.3, 0.6]), rng.normal(size=(9, 9))
    asked = np.argwhere(~occupied)
    for cell, tri in zip(asked, interpolation.triangles(occupied, asked, reach, low), strict=True):
        want = plain_triangle(occupied, cell, reach, low)
        assert (want is None) == (tri[0, 0] < 0)
        if want is not None:
            got, other = ((interpolation.barycentric(cell[None], t[None])[0] * value[t[:, 0], t[:, 1]]).sum() for t in (tri, want))
            assert got == pytest.approx(other, abs=1e-9)


def test_cells_between_two_lone_ones_end():
    """Only two cells occupied: no triangle, and no search without end on the line between them."""
    for occupied in ([(3, 2), (3, 4)], [(3, 2), (3, 5), (2, 5)], [(0, 0), (6, 6)], [(0, 3), (6, 3), (3, 0), (3, 6)]):
        m = np.zeros((7, 7), bool)
        m[tuple(np.array(occupied).T)] = True
        for low in ((45, 9), (0, 0), (-7, 1000)):
            found = interpolation.triangles(m, np.argwhere(~m), 3, low)
            assert (found[:, 0, 0] >= 0).any() == (len(occupied) > 2)


def test_wide_gaps_share_triangles():
    rng = np.random.default_rng(3)
    occupied = rng.random((90, 90)) < 0.5
    occupied[20:70, 25:60] = False
    occupied[40, 40] = True
    asked = np.argwhere(~occupied)
    tri = interpolation.triangles(occupied, asked, 60, (0, 0))
    found = tri[:, 0, 0] >= 0
    assert found[(asked > 5).all(axis=1) & (asked < 85).all(axis=1)].all()
    assert interpolation.barycentric(asked[found], tri[found]).min() > -1e-9
    for cell, t in list(zip(asked[found], tri[found], strict=True))[::37]:  # no cell inside of the circle
        d = (np.argwhere(occupied) - cell).astype(float)
        own = (t - cell).astype(float)
        a, b, c = np.linalg.solve(np.column_stack((own[:, 1], own[:, 0], np.ones(3))), (own * own).sum(axis=1))
        assert ((d * d).sum(axis=1) - a * d[:, 1] - b * d[:, 0] - c).min() > -0.01


def raster_of(spark, f, n=40, share=0.5, seed=5):
    rng = np.random.default_rng(seed)
    rows = [("c", r, c, float(f(r, c))) for r in range(n) for c in range(n) if rng.random() < share]
    return spark.createDataFrame(rows, "cloud_id string, row long, col long, value double"), {(r, c): v for _, r, c, v in rows}


def dense(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_linear_keeps_planes_and_cubic_keeps_quadratics(spark):
    plane, quadratic = (lambda r, c: 2 * r - c + 1), (lambda r, c: 0.01 * r * r - 0.02 * r * c + 0.03 * c * c + r - 2 * c)
    for f, method in ((plane, "linear"), (quadratic, "cubic")):
        cells, held = raster_of(spark, f)
        got = dense(raster.fill_gaps(cells, method, reach=12))
        assert len(got) > 1500 and all(got[k] == v for k, v in held.items())
        assert max(abs(v - f(*k)) for k, v in got.items()) < 1e-8


def test_tiles_change_nothing(spark):
    cells, _ = raster_of(spark, lambda r, c: np.sin(r / 3) * np.cos(c / 5), share=0.3)
    named = cells.select(F.col("cloud_id").alias("g"), "row", "col", "value", F.lit(0).alias("top"), F.lit(0).alias("left"), F.lit(39).alias("bottom"), F.lit(39).alias("right"))
    for cubic in (False, True):
        one, many, more = (dense(interpolation.fill_triangles(named, cubic, reach=8, tile=t)) for t in (100, 7, 16))
        assert one.keys() == many.keys() == more.keys() and len(one) > 900
        assert max(abs(one[k] - other[k]) for k in one for other in (many, more)) < 1e-12


def test_cubic_equals_a_dense_version(spark):
    """Slopes from a search over all cells and patches one at a time, written out by their control points."""
    cells, held = raster_of(spark, lambda r, c: np.sin(r / 4) + np.cos(c / 3), n=16, share=0.45)
    got = dense(raster.fill_gaps(cells, "cubic", reach=6))
    keys = sorted(held)

    def slope(k):
        near = sorted(((o[0] - k[0]) ** 2 + (o[1] - k[1]) ** 2, o) for o in keys if o != k)[:12]
        d = np.array([(o[0] - k[0], o[1] - k[1]) for _, o in near], float)
        w = np.array([1 / q for q, _ in near])
        terms = np.column_stack((d, d[:, 0] ** 2, d[:, 0] * d[:, 1], d[:, 1] ** 2))
        return np.linalg.lstsq(terms * np.sqrt(w)[:, None], np.array([held[o] - held[k] for _, o in near]) * np.sqrt(w), rcond=None)[0][:2]

    occupied = np.zeros((16, 16), bool)
    occupied[tuple(np.array(keys).T)] = True
    filled = [k for k in got if k not in held]
    assert len(filled) > 80
    for k in filled[::3]:
        tri = plain_triangle(occupied, np.array(k), 6, (0, 0))
        v, z, g = tri.astype(float), [held[tuple(t)] for t in tri.tolist()], [slope(tuple(t)) for t in tri.tolist()]
        s = v.mean(axis=0)
        inner = [z[i] + g[i] @ (s - v[i]) / 3 for i in range(3)]
        mids = {}
        for a, b in ((0, 1), (1, 2), (2, 0)):
            e = v[b] - v[a]
            n = np.array([-e[1], e[0]])
            # slope across the side at its middle is the mean of those at its ends: solve for the middle control point
            def across(m, t, a=a, b=b, n=n):
                ctrl = {(3, 0, 0): z[a], (2, 1, 0): z[a] + g[a] @ (v[b] - v[a]) / 3, (1, 2, 0): z[b] + g[b] @ (v[a] - v[b]) / 3, (0, 3, 0): z[b], (2, 0, 1): inner[a], (1, 1, 1): m, (0, 2, 1): inner[b]}
                step = np.linalg.solve(np.column_stack((np.vstack((v[a], v[b], s)).T[0], np.vstack((v[a], v[b], s)).T[1], np.ones(3))).T, [n[0], n[1], 0])
                quad = lambda i, j: sum(step[x] * ctrl[tuple(np.array((i, j, 0)) + np.eye(3, dtype=int)[x])] for x in range(3))
                return 3 * ((1 - t) ** 2 * quad(2, 0) + 2 * t * (1 - t) * quad(1, 1) + t * t * quad(0, 2))
            off = lambda m: across(m, 0.5) - (across(m, 0.0) + across(m, 1.0)) / 2
            mids[a, b] = mids[b, a] = -off(0.0) / (off(1.0) - off(0.0))
        second = [(inner[i] + mids[i, (i + 1) % 3] + mids[i, (i + 2) % 3]) / 3 for i in range(3)]
        w = interpolation.barycentric(np.array([k]), tri[None])[0]
        c = int(w.argmin())
        a, b = (c + 1) % 3, (c + 2) % 3
        p, q, u = w[a] - w[c], w[b] - w[c], 3 * w[c]
        near_a, near_b = z[a] + g[a] @ (v[b] - v[a]) / 3, z[b] + g[b] @ (v[a] - v[b]) / 3
        want = p**3 * z[a] + 3 * p * p * q * near_a + 3 * p * q * q * near_b + q**3 * z[b] + 3 * p * p * u * inner[a] + 6 * p * q * u * mids[a, b] + 3 * q * q * u * inner[b] + 3 * p * u * u * second[a] + 3 * q * u * u * second[b] + u**3 * sum(second) / 3
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_outside_of_the_hull_stays_empty(spark):
    rows = [("c", 0, 0, 1.0), ("c", 0, 4, 1.0), ("c", 4, 0, 1.0), ("d", 2, 2, 5.0)]
    r = spark.createDataFrame(rows, "cloud_id string, row long, col long, value double")
    shape = spark.createDataFrame([("c", 9, 9), ("d", 9, 9)], "cloud_id string, nrow long, ncol long")
    got = raster.fill_gaps(r, "linear", shape=shape, reach=10).collect()
    assert {(x["row"], x["col"]) for x in got if x["cloud_id"] == "c"} == {(a, b) for a in range(5) for b in range(5) if a + b <= 4}
    assert {x["value"] for x in got if x["cloud_id"] == "c"} == {1.0} and sum(x["cloud_id"] == "d" for x in got) == 1
    assert raster.fill_gaps(r.limit(0), "cubic", shape=shape).count() == 0
