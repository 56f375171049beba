"""Gaps of rasters filled over the Delaunay triangles of the occupied cells: linear or with Clough-Tocher cubic patches.

Lifted to a paraboloid, the triangle around an empty cell is the facet of the lower hull below it, so it is the
optimum of a linear program: weights of three occupied cells that give the empty cell's place at the least lifted height. Many
cells' programs are solved side by side by the simplex method, each over the cells of a window, which is widened
until the triangle's circle, which is empty, lies inside of it; then no cell outside can change the optimum. Cells of a grid
often lie on one circle, and any of several triangles would do; heights are raised by less than ``EPS``, by a
function of the cell's place, so that everyone who asks finds the same triangle.

A raster is cut to square tiles, dealt with a rim of ``reach`` cells; an empty cell whose triangle's circle goes
beyond ``reach`` cells from it stays empty, as do cells outside of the hull. So results do not depend on the tiles, and a
task holds one tile with its rim.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.operators.spatial import knn
from pointspark.shared import materialize

#: How much a height may be raised, and the modulus of the function that says by how much (fixed).
EPS, PRIME = 1e-4, 65521
#: A circle may go beyond ``reach`` by this much: no circle through cells of a grid ends exactly there.
SLACK = 0.3137
NONE = 1 << 30


def raised(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Between 0 and ``EPS``, by the cell's place."""
    r, c = np.mod(row, PRIME), np.mod(col, PRIME)
    return EPS * (np.mod(r * r * 7919 + r * c * 6151 + c * c * 4421 + r * 3571 + c * 2879, PRIME) / PRIME)


def facets(x: np.ndarray, y: np.ndarray, height: np.ndarray, begin: np.ndarray | None = None, beside: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of the lower hull below the origin, for many point sets over the same places.

    ``x``, ``y``: places (n); ``height``: heights of each set (sets, n), infinite where it has no point. Gives the
    numbers of the three points (sets, 3), -1 where no triangle holds the origin, and the plane (a, b, c) through them.
    ``begin`` may name triangles to start from. In truth the place asked for is a little beside the origin, on one of two
    sides, so that it is on no line between points.
    """
    wide = 8.0 * (np.abs(x).max(initial=1) + np.abs(y).max(initial=1))
    far = 1e3 * wide * wide  # three far points that a set's own push out wherever they can
    px, py = np.append(x, [-4 * wide, 4 * wide, 0.0]), np.append(y, [-3 * wide, -3 * wide, 5 * wide])
    n, sets = len(x), len(height)
    ph = np.column_stack((height, np.full((sets, 3), far)))
    basis = np.tile(np.arange(n, n + 3), (sets, 1))
    if begin is not None:
        basis = np.where((begin >= 0).all(axis=1)[:, None], begin, basis)
    plane = np.zeros((sets, 3))
    qx, qy = beside * 1e-6, beside * 0.618e-6  # no weight is 0, so every step goes down
    todo = np.arange(sets)
    while len(todo):
        at = basis[todo]
        bx, by, bh = px[at], py[at], np.take_along_axis(ph[todo], at, axis=1)
        x1, y1, x2, y2 = bx[:, 1] - bx[:, 0], by[:, 1] - by[:, 0], bx[:, 2] - bx[:, 0], by[:, 2] - by[:, 0]
        det = x1 * y2 - x2 * y1
        h1, h2 = bh[:, 1] - bh[:, 0], bh[:, 2] - bh[:, 0]
        a, b = (h1 * y2 - h2 * y1) / det, (x1 * h2 - x2 * h1) / det
        c = bh[:, 0] - a * bx[:, 0] - b * by[:, 0]
        plane[todo] = np.column_stack((a, b, c))
        below = ph[todo][:, :n] - (a[:, None] * x + b[:, None] * y + c[:, None])
        if not n:
            break
        for j in range(3):  # points of the triangle are on the plane, but for rounding
            held = np.flatnonzero(at[:, j] < n)
            below[held, at[held, j]] = 0.0
        enter = below.argmin(axis=1)
        go = below[np.arange(len(todo)), enter] < -np.maximum(1e-9 * np.maximum(1.0, np.abs(c)), 1e-11 * np.abs(bh).max(axis=1))
        todo, enter = todo[go], enter[go]
        if not len(todo):
            break
        bx, by, x1, y1, x2, y2, det = (v[go] for v in (bx, by, x1, y1, x2, y2, det))

        def weights(tx, ty, bx=bx, by=by, x1=x1, y1=y1, x2=x2, y2=y2, det=det):
            dx, dy = tx - bx[:, 0], ty - by[:, 0]
            w1, w2 = (dx * y2 - dy * x2) / det, (dy * x1 - dx * y1) / det
            return np.column_stack((1 - w1 - w2, w1, w2))

        own, step = weights(qx, qy), weights(x[enter], y[enter])
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-12, np.maximum(own, 0.0) / step, np.inf)
        basis[todo, ratio.argmin(axis=1)] = enter
    return np.where((basis < n).all(axis=1)[:, None], basis, -1), plane


def circle_reach(plane: np.ndarray) -> np.ndarray:
    """How far the circles of ``facets`` go from the origin along either axis."""
    a, b, c = plane.T
    radius = np.sqrt(np.maximum(0.0, c + (a * a + b * b) / 4))
    return np.maximum(np.abs(a), np.abs(b)) / 2 + radius


def triangles(occupied: np.ndarray, asked: np.ndarray, reach: int, low: tuple[int, int], at_once: int = 1 << 21) -> np.ndarray:
    """For each empty cell (row, col) of ``asked`` the three cells (3 x 2) around it, -1 where there are none within ``reach``.

    ``occupied`` is a matrix whose first cell is ``low`` of the raster; it must hold all cells within ``reach``.
    """
    out = np.full((len(asked), 3, 2), -1, np.int64)
    pad = np.pad(occupied, reach)
    rows, cols = np.indices(pad.shape)
    raise_by = raised(rows + (low[0] - reach), cols + (low[1] - reach))
    inner = np.flatnonzero(in_hull(occupied, asked))
    missed = _search(out, asked, inner, pad, raise_by, reach, low, at_once, 1)
    _search(out, asked, missed, pad, raise_by, reach, low, at_once, -1)  # cells on the rim of the hull
    return out


def _search(out, asked, todo, pad, raise_by, reach: int, low: tuple[int, int], at_once: int, beside: int) -> np.ndarray:
    """Fills ``out`` for the cells ``todo`` and gives those that no triangle holds."""
    window, start, missed = min(4, reach), np.full((len(asked), 3, 2), NONE), []
    while len(todo):
        side = 2 * window + 1
        offsets = np.array(list(product(range(-window, window + 1), repeat=2)))
        flat = (offsets[:, 0] * pad.shape[1] + offsets[:, 1])[None, :]
        square = (offsets * offsets).sum(axis=1).astype(float)
        size, open_, left = max(1, at_once // len(offsets)), np.ones(len(todo), bool), []
        # wide triangles hold many cells: a few cells at a time, and then all that their triangles hold
        shared = window > 8
        place = {tuple(asked[i]): at for at, i in enumerate(todo)} if shared else {}
        while len(rest := np.flatnonzero(open_)):
            mine = rest[:: max(1, len(rest) // min(size, 64))][:size] if shared else rest[:size]
            own, known = asked[todo[mine]], start[todo[mine]]
            at = ((own[:, 0] + reach) * pad.shape[1] + own[:, 1] + reach)[:, None] + flat
            heights = np.where(pad.ravel()[at], square + raise_by.ravel()[at], np.inf)
            begin = np.where(known[..., 0] != NONE, (known[..., 0] + window) * side + known[..., 1] + window, -1)
            basis, plane = facets(offsets[:, 1].astype(float), offsets[:, 0].astype(float), heights, begin, beside)
            held = (basis >= 0).all(axis=1)
            start[todo[mine[held]]] = offsets[basis[held]]
            fits = held & (circle_reach(plane) < (reach + SLACK if window == reach else window + 0.9))
            found = own[fits][:, None, :] + offsets[basis[fits]]
            out[todo[mine[fits]]] = found
            open_[mine] = False
            left.append(mine[~fits])
            if window == reach:
                missed.append(todo[mine[~held]])
            for tri in np.unique(found, axis=0) if shared else ():
                for cell in _inside(tri):
                    other = place.get(cell)
                    if other is not None and open_[other] and _reaches(tri, cell, reach, low):
                        out[todo[other]], open_[other] = tri, False
        if window == reach:
            break
        todo = todo[np.sort(np.concatenate(left))]
        window = min(2 * window, reach)
    return np.concatenate(missed) if missed else todo[:0]


def in_hull(occupied: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which cells of ``asked`` lie in the convex hull of the occupied cells."""
    rows = np.flatnonzero(occupied.any(axis=1))
    if not len(rows) or not len(asked):
        return np.zeros(len(asked), bool)
    ends = {1: occupied[rows].argmax(axis=1), -1: occupied.shape[1] - 1 - occupied[rows][:, ::-1].argmax(axis=1)}
    inside = (asked[:, 0] >= rows[0]) & (asked[:, 0] <= rows[-1])
    for sign, cols in ends.items():  # the first and the last occupied cells of the rows, each side made convex
        chain: list[tuple[int, int]] = []
        for p in zip(rows.tolist(), (sign * cols).tolist(), strict=True):
            while len(chain) > 1 and (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) >= (p[1] - chain[-2][1]) * (chain[-1][0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        edge = np.interp(asked[:, 0], [p[0] for p in chain], [p[1] for p in chain])
        inside &= sign * asked[:, 1] >= edge - 1e-9
    return inside


def _inside(tri: np.ndarray) -> list[tuple[int, int]]:
    """Cells of a triangle, those on its sides among them."""
    (r0, c0), (r1, c1) = tri.min(axis=0), tri.max(axis=0)
    r, c = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
    side = [(tri[j, 1] - tri[i, 1]) * (r - tri[i, 0]) - (tri[j, 0] - tri[i, 0]) * (c - tri[i, 1]) for i, j in ((0, 1), (1, 2), (2, 0))]
    held = np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)
    return list(zip(r[held].tolist(), c[held].tolist(), strict=True))


def _reaches(tri: np.ndarray, cell: tuple[int, int], reach: int, low: tuple[int, int]) -> bool:
    """Whether the circle of a triangle stays within ``reach`` of a cell that it holds."""
    d = (tri - np.array(cell)).astype(float)
    h = (d * d).sum(axis=1) + raised(tri[:, 0] + low[0], tri[:, 1] + low[1])
    a, b, c = np.linalg.solve(np.column_stack((d[:, 1], d[:, 0], np.ones(3))), h)
    return circle_reach(np.array([[a, b, c]]))[0] < reach + SLACK


def barycentric(cells: np.ndarray, tri: np.ndarray) -> np.ndarray:
    d1, d2, d = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0], cells - tri[:, 0]
    det = (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]).astype(float)
    w1, w2 = (d[:, 0] * d2[:, 1] - d[:, 1] * d2[:, 0]) / det, (d1[:, 0] * d[:, 1] - d1[:, 1] * d[:, 0]) / det
    return np.column_stack((1 - w1 - w2, w1, w2))


def clough_tocher(cells: np.ndarray, tri: np.ndarray, value: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Values at ``cells`` of the cubic patches over ``tri`` (n, 3, 2) with ``value`` (n, 3) and ``slope`` (n, 3, 2) at the corners.

    Each triangle is parted at its centre; the derivative across a side is linear along it, so patches of neighbours meet smoothly.
    """
    v = tri.astype(float)
    centre = v.mean(axis=1)
    along = lambda i, p: (slope[:, i] * (p - v[:, i])).sum(axis=1) / 3
    spoke = np.stack([value[:, i] + along(i, centre) for i in range(3)], axis=1)  # next to each corner, towards the centre
    mid = np.empty((len(v), 3))  # in the part opposite to corner k
    edge = {}
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        near_a, near_b = value[:, a] + along(a, v[:, b]), value[:, b] + along(b, v[:, a])
        edge[k] = near_a, near_b
        e, u = v[:, b] - v[:, a], centre - v[:, a]
        t = (u * e).sum(axis=1) / (e * e).sum(axis=1)
        first = spoke[:, a] - value[:, a] - t * (near_a - value[:, a])
        last = spoke[:, b] - near_b - t * (value[:, b] - near_b)
        mid[:, k] = near_a + t * (near_b - near_a) + (first + last) / 2
    second = np.stack([(spoke[:, i] + mid[:, (i + 1) % 3] + mid[:, (i + 2) % 3]) / 3 for i in range(3)], axis=1)
    top = second.mean(axis=1)
    w = barycentric(cells, tri)
    part = w.argmin(axis=1)
    out = np.empty(len(v))
    for k in range(3):
        m = part == k
        a, b = (k + 1) % 3, (k + 2) % 3
        p, q, s = w[m, a] - w[m, k], w[m, b] - w[m, k], 3 * w[m, k]
        near_a, near_b = edge[k][0][m], edge[k][1][m]
        sides = p**3 * value[m, a] + 3 * p * p * q * near_a + 3 * p * q * q * near_b + q**3 * value[m, b]
        inner = 3 * p * p * s * spoke[m, a] + 6 * p * q * s * mid[m, k] + 3 * q * q * s * spoke[m, b]
        out[m] = sides + inner + 3 * p * s * s * second[m, a] + 3 * q * s * s * second[m, b] + s**3 * top[m]
    return out


def fitted_slope(d: np.ndarray, rise: np.ndarray) -> np.ndarray:
    """Slope (row, col) of the quadratic through a cell that fits its neighbours best: ``d`` (k, 2) steps, ``rise`` (k) differences.

    Neighbours count by the square of their nearness; of several that fit as well the flattest is taken.
    """
    near = 1 / np.sqrt((d * d).sum(axis=1))
    terms = np.column_stack((d, d[:, 0] ** 2 / 2, d[:, 0] * d[:, 1], d[:, 1] ** 2 / 2))
    return (np.linalg.pinv(terms * near[:, None], rcond=1e-10) @ (rise * near))[:2]


def slopes(cells: DataFrame, neighbours: int) -> DataFrame:
    """``cells`` (g, row, col, value) with ``dr, dc``: slopes from the quadratic that fits the nearest occupied cells."""
    side = F.lit(1 << 24)
    named = materialize(cells.select(F.col("g").alias("cloud_id"), (F.col("row") * side + F.col("col")).alias("pid"), F.col("row").cast("double").alias("x"), F.col("col").cast("double").alias("y"), "value"), "raster-cells")
    near = knn(named, neighbours, "xy").select("cloud_id", "src", "dst")
    other = named.select("cloud_id", F.col("pid").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("value").alias("ov"))
    met = named.join(near, (near["cloud_id"] == named["cloud_id"]) & (near["src"] == named["pid"]), "left").select(named["cloud_id"], "pid", "x", "y", "value", "dst").join(other, ["cloud_id", "dst"], "left")
    lists = met.groupBy("cloud_id", "pid", "x", "y", "value").agg(F.array_sort(F.collect_list(F.when(F.col("dst").isNotNull(), F.struct("dst", (F.col("ox") - F.col("x")).alias("r"), (F.col("oy") - F.col("y")).alias("c"), (F.col("ov") - F.col("value")).alias("v"))))).alias("near"))

    def fit(batches):
        for batch in batches:
            n = np.diff(batch.column("near").offsets.to_numpy())
            ends = np.cumsum(n)
            parts = batch.column("near").flatten()
            r, c, v = (parts.field(f).to_numpy(zero_copy_only=False) for f in ("r", "c", "v"))
            found = np.array([fitted_slope(np.column_stack((r[e - k : e], c[e - k : e])), v[e - k : e]) if k else (0.0, 0.0) for k, e in zip(n, ends, strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"g": batch.column("g"), "row": batch.column("row"), "col": batch.column("col"), "value": batch.column("value"), "dr": pa.array(found[:, 0]), "dc": pa.array(found[:, 1])})

    return lists.select(F.col("cloud_id").alias("g"), F.col("x").cast("long").alias("row"), F.col("y").cast("long").alias("col"), "value", "near").mapInArrow(fit, "g string, row long, col long, value double, dr double, dc double")


def fill_triangles(cells: DataFrame, cubic: bool = False, reach: int = 64, neighbours: int = 12, tile: int | None = None) -> DataFrame:
    """``g, row, col, value`` of the empty cells filled.

    ``cells``: g (string), row, col, value, and top, left, bottom, right: the first and last rows and columns to fill.
    """
    tile = tile or 4 * reach
    bounds = ["top", "left", "bottom", "right"]
    shape = cells.select("g", *bounds).distinct()
    rows = cells.select("g", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    rows = slopes(rows, neighbours) if cubic else rows.withColumns({"dr": F.lit(0.0), "dc": F.lit(0.0)})
    for c, t in (("row", "ti"), ("col", "tj")):
        first, last = (F.floor((F.col(c) + F.lit(o)) / F.lit(tile)).cast("long") for o in (-reach, reach))
        rows = rows.withColumn(t, F.explode(F.sequence(first, last)))
    rows = rows.join(shape, "g")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        top, left, bottom, right = (int(pdf[b].iloc[0]) for b in bounds)
        low = (ti * tile - reach, tj * tile - reach)
        side = tile + 2 * reach
        r, c = pdf["row"].to_numpy() - low[0], pdf["col"].to_numpy() - low[1]
        held = np.zeros((side, side), bool)
        held[r, c] = True
        fields = {}
        for name in ("value", "dr", "dc"):
            fields[name] = np.zeros((side, side))
            fields[name][r, c] = pdf[name].to_numpy()
        inner = np.zeros_like(held)
        inner[max(reach, top - low[0]) : min(reach + tile, bottom - low[0] + 1), max(reach, left - low[1]) : min(reach + tile, right - low[1] + 1)] = True
        asked = np.argwhere(inner & ~held)
        tri = triangles(held, asked, reach, low)
        found = tri[:, 0, 0] >= 0
        asked, tri = asked[found], tri[found]
        at = lambda name: fields[name][tri[..., 0], tri[..., 1]]
        if not len(asked):
            out = np.empty(0)
        elif cubic:
            out = clough_tocher(asked, tri, at("value"), np.stack((at("dr"), at("dc")), axis=2))
        else:
            out = (barycentric(asked, tri) * at("value")).sum(axis=1)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "row": asked[:, 0] + low[0], "col": asked[:, 1] + low[1], "value": out})

    return rows.groupBy("g", "ti", "tj").applyInPandas(fill, "g string, row long, col long, value double")
