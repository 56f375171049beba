"""Neighbour joins on a grid: equi-joins on cells or tiles, then an exact distance test. Ties go to the smaller identifier."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.shared import discard, materialize

#: Cells along each side of a tile, and what a tile should hold at most: candidates, and queries in one task.
TILE, MOST = 4, 100_000
#: Cells are a little wider than what they must reach, so that rounding never hides a neighbour.
WIDER = 1 + 1e-9


def squared(axes: str, left: str = "l", right: str = "r") -> Column:
    return reduce(lambda a, b: a + b, [(F.col(f"{left}{a}") - F.col(f"{right}{a}")) * (F.col(f"{left}{a}") - F.col(f"{right}{a}")) for a in axes])


def _named(df: DataFrame, id_col: str, axes: str, prefix: str) -> DataFrame:
    return df.select("cloud_id", F.col(id_col).alias(prefix + "id"), *[F.col(a).alias(prefix + a) for a in axes])


def grid_range_join(left: DataFrame, right: DataFrame, cell: float, axes: str = "xyz", left_id: str = "pid", right_id: str = "pid") -> DataFrame:
    """Candidate pairs from the same or adjacent cells, with ``d2``: holds every pair nearer than ``cell``.

    The right side is dealt to the 3^d cells around its own, so give the smaller frame on the right.
    """
    l = _named(left, left_id, axes, "l").withColumns({"c" + a: F.floor(F.col("l" + a) / F.lit(float(cell))) for a in axes})
    steps = F.array(*[F.struct(*[F.lit(v).alias("s" + a) for v, a in zip(s, axes, strict=True)]) for s in product((-1, 0, 1), repeat=len(axes))])
    r = _named(right, right_id, axes, "r").withColumn("s", F.explode(steps))
    r = r.withColumns({"c" + a: F.floor(F.col("r" + a) / F.lit(float(cell))) + F.col("s.s" + a) for a in axes}).drop("s")
    return l.join(r, ["cloud_id", *["c" + a for a in axes]]).withColumn("d2", squared(axes)).drop(*["c" + a for a in axes])


def _runs(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (length[i] of them), one run after the other."""
    skip = first - np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.repeat(skip, length) + np.arange(length.sum())


def _places(x: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Order of the rows by place (and ``ids``), and where in it a place begins; None where few rows share a place."""
    mixed = reduce(np.bitwise_xor, (np.ascontiguousarray(x[:, i]).view(np.int64) * m for i, m in enumerate((-7046029254386353131, 6364136223846793005, 2685821657736338717)[: x.shape[1]])))
    if 2 * len(np.unique(mixed)) > len(x):
        return None
    order = np.lexsort((*x.T,) if ids is None else (ids, *x.T))
    new = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(np.concatenate(([True], new)))


def nearest(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, cell: float, same: bool, bound: float = math.inf, apart: bool = False, at_once: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, identifier, squared distance and rank of the ``k`` nearest rows of ``c`` among all nearer than ``cell``.

    What lies farther than ``cell`` is found only in part, and nothing at ``bound`` or beyond; ``apart`` passes over rows at the query's
    place. Where many rows share places, of the rows of ``c`` at one only those that may be neighbours are met, and queries at one place
    are answered together: by one neighbour more, if ``same``, so that each can do without itself.
    """
    need, found, met, met_ids = k + same, _places(c, c_ids), c, c_ids
    if found:
        order, first = found
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
        met, met_ids = c[order[place < need]], c_ids[order[place < need]]
    asked = _places(q)
    if asked:
        order, first = asked
        size = np.diff(np.append(first, len(q)))
        at, dst, d2, rank = _nearest(q[order[first]], None, met, met_ids, need, cell, bound, apart, at_once)
        by = np.lexsort((rank, at))
        dst, d2 = dst[by], d2[by]
        n = np.bincount(at, minlength=len(first))
        length, begin = np.repeat(n, size), np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), size)
        some = _runs(begin, length)
        row, dst, d2 = np.repeat(order, length), dst[some], d2[some]
    else:
        at, dst, d2, rank = _nearest(q, q_ids if same and not found else None, met, met_ids, need if found else k, cell, bound, apart, at_once)
        if not (same and found):
            return at, dst, d2, rank
        by = np.lexsort((rank, at))
        row, dst, d2 = at[by], dst[by], d2[by]
    own = dst == q_ids[row] if same else np.zeros(len(row), bool)
    twice = np.flatnonzero(np.bincount(row[own], minlength=len(q)) > 1)  # identifiers that are not unique
    keep = ~own
    keep[np.isin(row, twice)] = False
    row, dst, d2 = row[keep], dst[keep], d2[keep]
    new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))[: len(row)]
    rank = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    out = [x[rank < k] for x in (row, dst, d2, rank)]
    if len(twice):
        again = _nearest(q[twice], q_ids[twice], c, c_ids, k, cell, bound, apart, at_once)
        out = [np.concatenate(x) for x in zip(out, (twice[again[0]], *again[1:]), strict=True)]
    return tuple(out)


def _first(row: np.ndarray, d2: np.ndarray, dst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of ``row`` the ``k`` first of each by ``d2, dst``, with their ranks; a few are picked one by one, without sorting."""
    new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))[: len(row)]
    size = np.diff(np.append(new, len(row)))
    if k > 8 or not len(row):
        best = np.lexsort((dst, d2, row))
        rank = np.arange(len(row)) - np.repeat(new, size)
        best, rank = best[rank < k], rank[rank < k]
        return row[best], d2[best], dst[best], rank
    left, out = d2.copy(), []
    for rank in range(k):
        low = np.minimum.reduceat(left, new)
        at = np.flatnonzero(left == np.repeat(low, size))
        of = np.repeat(np.arange(len(new)), size)[at]
        if len(at) > len(new):
            begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            ident = np.minimum.reduceat(dst[at], begin)
            at = at[dst[at] == np.repeat(ident, np.diff(np.append(begin, len(at))))]
            at = at[np.concatenate(([True], row[at[1:]] != row[at[:-1]]))]
        at = at[left[at] < math.inf]
        if not len(at):
            break
        out.append((at, np.full(len(at), rank)))
        left[at] = math.inf
    at, rank = (np.concatenate(x) for x in zip(*out, strict=True))
    return row[at], d2[at], dst[at], rank


def _nearest(q: np.ndarray, q_ids: np.ndarray | None, c: np.ndarray, c_ids: np.ndarray, k: int, cell: float, bound: float, apart: bool, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``nearest``, all rows met; a row of ``c`` that has the identifier of the query, where ``q_ids`` is given, is no neighbour.

    Rows of ``c`` are sorted by the cells of a grid; a query reads the cells around its own. The grid starts as fine
    as the rows are dense; a query whose kth distance is beyond a cell goes on with cells twice as wide.
    """
    dims, low = q.shape[1], np.minimum(q.min(axis=0), c.min(axis=0))
    span = np.maximum(np.maximum(q.max(axis=0), c.max(axis=0)) - low, cell / 1024)
    side = float(np.clip((span.prod() * (k + 1) / len(c)) ** (1 / dims), cell / 1024, cell))
    todo, found = np.arange(len(q)), []
    while len(todo):
        side = cell if 1.5 * side >= cell else side
        shape = (span / side).astype(np.int64) + 4
        steps = np.append(np.cumprod(shape[::-1])[::-1][1:], 1)  # of the last axis: neighbours are next to each other
        keys = ((c - low) / side + 1).astype(np.int64) @ steps
        order = np.argsort(keys, kind="stable")
        keys, cs, ids = keys[order], c[order], c_ids[order]
        own = ((q[todo] - low) / side + 1).astype(np.int64) @ steps
        around = own[:, None] + np.array([int(np.dot(o, steps[:-1])) for o in product((-1, 0, 1), repeat=dims - 1)], np.int64)[None, :]
        first = np.searchsorted(keys, around - 1)
        length = np.searchsorted(keys, around + 1, "right") - first
        ends = np.cumsum(length.sum(axis=1))
        rest, at = [], 0
        while at < len(todo):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
            n = length[at:end].sum(axis=1)
            row = np.repeat(todo[at:end], n)
            met = _runs(first[at:end].ravel(), length[at:end].ravel())
            d2 = reduce(np.add, ((q[row, i] - cs[met, i]) ** 2 for i in range(dims)))
            keep = d2 < bound * bound
            if q_ids is not None:
                keep &= ids[met] != q_ids[row]
            if apart:
                keep &= d2 > 0
            row, d2, dst = row[keep], d2[keep], ids[met[keep]]
            row, d2, dst, rank = _first(row, d2, dst, k)
            if side < cell:
                done = np.zeros(len(q), bool)
                done[row[(rank == k - 1) & (np.sqrt(d2) * WIDER < side)]] = True
                own_done = done[row]
                row, d2, dst, rank = row[own_done], d2[own_done], dst[own_done], rank[own_done]
                rest.append(todo[at:end][~done[todo[at:end]]])
            found.append((row, dst, d2, rank))
            at = end
        if side == cell:
            break
        todo, side = np.concatenate(rest), 2 * side
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, np.empty(0), none)


def _in_tiles(todo: DataFrame, other: DataFrame, k: int, cell: float, axes: str, same: bool, bound: float = math.inf, apart: bool = False) -> DataFrame:
    """``cloud_id, src, dst, dist, rank``: ``nearest`` by tiles of ``TILE`` cells a side, each with the cells around it.

    ``todo`` and ``other``: cloud_id, id, axes. A tile with more than ``MOST`` queries is dealt to several tasks, all of
    which get its candidates; tiles without a query get none.
    """
    at = [F.floor(F.col(a) / F.lit(cell)).cast("long") for a in axes]
    home = F.struct(*[F.floor(c / F.lit(TILE)).cast("long").alias(a) for c, a in zip(at, axes, strict=True)])
    asked = todo.withColumn("_t", home)
    tiles = asked.groupBy("cloud_id", "_t").agg(F.ceil(F.count("*") / F.lit(MOST)).cast("int").alias("_parts"))
    asked = asked.join(tiles, ["cloud_id", "_t"]).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    met = other
    for c, a in zip(at, axes, strict=True):  # the tile, and the one next to it where the cell is at its rim
        met = met.withColumn(f"_t{a}", F.explode(F.array_distinct(F.array(*[F.floor((c + o) / F.lit(TILE)).cast("long") for o in (-1, 0, 1)]))))
    met = met.withColumn("_t", F.struct(*[F.col(f"_t{a}").alias(a) for a in axes])).join(tiles, ["cloud_id", "_t"])
    met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cols = ["cloud_id", "_t", "_part", "id", *axes]
    both = asked.select(*cols, F.lit(True).alias("_asks")).unionByName(met.select(*cols, F.lit(False).alias("_asks")))

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("_asks").to_numpy(zero_copy_only=False)
        ids = group.column("id").to_numpy()
        x = np.column_stack([group.column(a).to_numpy() for a in axes])
        src, dst, d2, rank = nearest(x[asks], ids[asks], x[~asks], ids[~asks], k, cell, same, bound, apart) if asks.any() and not asks.all() else (ids[:0], ids[:0], np.empty(0), ids[:0])
        cloud = pa.array([group.column("cloud_id")[0].as_py()] * len(src), pa.string())
        return pa.table({"cloud_id": cloud, "src": pa.array(ids[asks][src], pa.int64()), "dst": pa.array(dst, pa.int64()), "dist": pa.array(np.sqrt(d2)), "rank": pa.array(rank + 1, pa.int32())})

    return both.groupBy("cloud_id", "_t", "_part").applyInArrow(run, "cloud_id string, src long, dst long, dist double, rank int")


def _plain(df: DataFrame, ident: str, axes: str) -> DataFrame:
    """``cloud_id, id, axes`` of the rows that have a place."""
    rows = df.select("cloud_id", F.col(ident).cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes])
    return rows.filter(reduce(lambda p, q: p & q, [F.col("id").isNotNull(), *[F.col(a).isNotNull() & (F.abs(a) < math.inf) for a in axes]]))


def _fullest(rows: DataFrame, cell: float, axes: str) -> int:
    """Rows in the fullest tile, without its rim."""
    tiles = rows.groupBy("cloud_id", *[F.floor(F.floor(F.col(a) / F.lit(cell)) / F.lit(TILE)).alias("_" + a) for a in axes]).agg(F.count("*").alias("_n"))
    return tiles.agg(F.max("_n")).first()[0] or 0


def _typed(near: DataFrame, left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    return near.select("cloud_id", F.col("src").cast(left.schema[left_id].dataType).alias("src"), F.col("dst").cast(right.schema[right_id].dataType).alias("dst"), "dist", "rank")


def _search(points: DataFrame, other: DataFrame, k: int, axes: str, same: bool, cell: float, last: float, bound: float, apart: bool = False) -> DataFrame:
    """Levels of cells twice as wide each, up to ``last``; a row whose kth distance is within a cell is done."""
    todo, found = points, None
    while True:
        if cell * 1.5 >= last:
            near = _in_tiles(todo, other, k, last, axes, same, bound, apart)
            return near if found is None else found.unionByName(near)
        near = materialize(_in_tiles(todo, other, k, cell, axes, same, bound, apart), "near")
        done = near.filter((F.col("rank") == k) & (F.col("dist") * WIDER < cell)).select("cloud_id", "src")
        kept = near.join(done, ["cloud_id", "src"], "left_semi")
        rest = materialize(todo.join(done.withColumnRenamed("src", "id"), ["cloud_id", "id"], "left_anti"), "rest")
        found = kept if found is None else found.unionByName(kept)
        discard(todo)
        todo = rest
        if todo.isEmpty():
            return found
        cell *= 2


def knn_bounded(points: DataFrame, k: int, bound: float, axes: str = "xyz", right: DataFrame | None = None, left_id: str = "pid", right_id: str = "pid", apart: bool = False) -> DataFrame:
    """``cloud_id, src, dst, dist, rank``: up to ``k`` nearest strictly within ``bound``; a self join leaves out the row itself, ``apart`` rows at distance 0.

    Cells are as wide as the bound, or half, a quarter, ... of it where that many rows stand in one tile; then most rows
    are done before the cells reach the bound.
    """
    same, other = right is None, points if right is None else right
    mine, theirs = _plain(points, left_id, axes), _thinned(_plain(other, right_id, axes), axes, k + same)
    last = cell = float(bound) * WIDER
    halved = 0
    while _fullest(theirs, cell, axes) > MOST and cell > last / 4096:
        cell, halved = cell / 2, halved + 1
        if halved == 6:  # perhaps many rows at one place
            theirs, cell = materialize(_first_at_place(theirs, axes, k + same), "places"), last
    return _typed(_search(mine, theirs, k, axes, same, cell, last, float(bound), apart), points, left_id, other, right_id)


def knn(points: DataFrame, k: int, axes: str = "xyz", right: DataFrame | None = None, left_id: str = "pid", right_id: str = "pid") -> DataFrame:
    """The ``k`` nearest without a bound, exact.

    A level answers every row whose kth distance is within a cell: nothing outside of the cells around it can be
    nearer. The rest is searched again with cells twice as wide, as long as no tile of them holds more than about ``MOST``
    rows; rows that are far from any others are then led to their nearest cells (see ``_descend``).
    """
    same, other = right is None, points if right is None else right
    mine, theirs = _plain(points, left_id, axes), _thinned(_plain(other, right_id, axes), axes, k + same)
    spans = [F.max(a) - F.min(a) for a in axes]
    width = mine.drop("id").unionByName(theirs.drop("id")).groupBy("cloud_id").agg(*[s.alias("s" + a) for s, a in zip(spans, axes, strict=True)]).agg(*[F.max("s" + a) for a in axes]).first()
    last = max([w for w in width if w is not None] or [0.0], default=0.0) * WIDER or 1.0
    count = theirs.groupBy("cloud_id").count().agg(F.max("count")).first()[0] or 0
    # about a tile's worth of rows in each tile if they were spread evenly, fewer where they are dense
    cell = min(last, last * (MOST / 8 / max(count, 1)) ** (1 / len(axes)))
    halved = 0
    while _fullest(theirs, cell, axes) > MOST // 4 and cell > last / 2**30:
        cell, halved = cell / 2, halved + 1
        if halved == 6:  # perhaps many rows at one place
            theirs = materialize(_first_at_place(theirs, axes, k + same), "places")
            while cell * 2 < last and _fullest(theirs, 2 * cell, axes) <= MOST // 4:
                cell *= 2
    todo, found = mine, None
    while True:
        final = cell * 1.5 >= last
        near = _in_tiles(todo, theirs, k, last if final else cell, axes, same)
        if final:
            return _typed(near if found is None else found.unionByName(near), points, left_id, other, right_id)
        near = materialize(near, "near")
        done = near.filter((F.col("rank") == k) & (F.col("dist") * WIDER < cell)).select("cloud_id", "src")
        kept = near.join(done, ["cloud_id", "src"], "left_semi")
        found = kept if found is None else found.unionByName(kept)
        last_todo, todo = todo, materialize(todo.join(done.withColumnRenamed("src", "id"), ["cloud_id", "id"], "left_anti"), "rest")
        discard(last_todo)
        if todo.isEmpty():
            return _typed(found, points, left_id, other, right_id)
        cell *= 2
        if _fullest(theirs, last if cell * 1.5 >= last else cell, axes) > MOST // 4:
            return _typed(found.unionByName(_descend(todo, theirs, k, axes, same)), points, left_id, other, right_id)


def _first_at_place(rows: DataFrame, axes: str, n: int) -> DataFrame:
    """Of the rows at one place those of the ``n`` smallest identifiers: no other is among the ``n`` nearest of any row."""
    place = Window.partitionBy("cloud_id", *axes).orderBy("id")
    return rows.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= n).drop("_n")


def _thinned(rows: DataFrame, axes: str, n: int) -> DataFrame:
    """``rows``, or what ``_first_at_place`` leaves of them where that is less than half."""
    size = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*axes)).alias("places")).first()
    return materialize(_first_at_place(rows, axes, n), "places") if 2 * n * size["places"] < size["rows"] else rows


def _descend(todo: DataFrame, other: DataFrame, k: int, axes: str, same: bool, few: int = 256) -> DataFrame:
    """``cloud_id, src, dst, dist, rank`` of the ``k`` nearest, down a pyramid of cells, for rows that are few or far from others.

    A cell of the pyramid knows how many rows it holds and their box. Level by level each row of ``todo`` looks at the parts of the
    cells that it has kept: some of them certainly hold ``k`` rows, within the farthest corner of the last of them,
    and parts that begin beyond that are dropped. Where the cells left have ``few`` rows at most, the rows themselves are compared. Every
    step is a join on cells; what a row keeps is near its answer, however many rows a cloud has.
    """
    dims = len(axes)
    step = 6 // dims  # levels at once: 64 parts of a cell
    depth = 60 // dims // step * step
    need = k + same
    rows = _first_at_place(other, axes, need)
    spans = [F.max(a) - F.min(a) for a in axes]
    box = rows.groupBy("cloud_id").agg(*[F.min(a).alias("lo" + a) for a in axes], F.greatest(*spans, F.lit(1e-300)).alias("wide"))
    coded = rows.join(box, "cloud_id").withColumns({"c" + a: F.least(F.floor((F.col(a) - F.col("lo" + a)) / F.col("wide") * float(2**depth)), F.lit(2**depth - 1)).cast("long") for a in axes})
    digit = lambda a, at: F.shiftright(F.col("c" + a), at).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
    # a cell's code: its parts' numbers from the top down, each of ``step`` bits an axis
    code = reduce(lambda x, y: x + y, [F.shiftleft(digit(a, depth - step * (level + 1)), step * dims * (depth // step - 1 - level) + step * i) for level in range(depth // step) for i, a in enumerate(axes)])
    coded = materialize(coded.select("cloud_id", "id", *axes, code.alias("code")), "coded")
    bits = step * dims
    asked = todo.select("cloud_id", F.col("id").alias("src"), *[F.col(a).alias("q" + a) for a in axes])
    by_query = Window.partitionBy("cloud_id", "src").orderBy("far", "code").rowsBetween(Window.unboundedPreceding, 0)
    state = None
    for level in range(depth // step - 1, -1, -1):
        cells = coded.groupBy("cloud_id", F.shiftright("code", bits * level).alias("code")).agg(F.count("*").alias("n"), *[F.min(a).alias("a" + a) for a in axes], *[F.max(a).alias("b" + a) for a in axes])
        if state is None:
            deal = F.explode(F.sequence(F.lit(0), F.lit(63)))  # so that a cloud's rows do not meet in one task
            met = asked.withColumn("_s", F.pmod(F.xxhash64("src"), F.lit(64)).cast("int")).join(cells.withColumn("_s", deal), ["cloud_id", "_s"]).drop("_s")  # with the cells at the top
        else:
            met = state.select("cloud_id", "src", *["q" + a for a in axes], F.col("code").alias("up")).join(cells.withColumn("up", F.shiftright("code", bits)), ["cloud_id", "up"]).drop("up")
        gap = [F.greatest(F.col("a" + a) - F.col("q" + a), F.col("q" + a) - F.col("b" + a), F.lit(0.0)) for a in axes]
        reach = [F.greatest(F.abs(F.col("q" + a) - F.col("a" + a)), F.abs(F.col("b" + a) - F.col("q" + a))) for a in axes]
        total = lambda v: reduce(lambda x, y: x + y, [d * d for d in v])
        met = met.withColumns({"near": total(gap), "far": total(reach)})
        enough = F.when(F.sum("n").over(by_query) >= need, F.col("far"))
        met = met.withColumn("enough", enough).withColumn("bound", F.min("enough").over(Window.partitionBy("cloud_id", "src")))
        kept = met.filter(F.col("bound").isNull() | (F.col("near") <= F.col("bound") * WIDER)).select("cloud_id", "src", *["q" + a for a in axes], "code", "n")
        last, state = state, materialize(kept, "kept-cells")
        discard(last)
        if (state.agg(F.max("n")).first()[0] or 0) <= few:
            break
    at = coded.withColumn("cell", F.shiftright("code", bits * level))
    pairs = state.select("cloud_id", F.col("src").alias("lid"), *[F.col("q" + a).alias("l" + a) for a in axes], F.col("code").alias("cell")).join(at.select("cloud_id", "cell", F.col("id").alias("rid"), *[F.col(a).alias("r" + a) for a in axes]), ["cloud_id", "cell"])
    if same:
        pairs = pairs.filter("lid <> rid")
    return _ranked(pairs.withColumn("d2", squared(axes)), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("cloud_id", "lid").orderBy("d2", "rid")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("cloud_id", F.col("lid").alias("src"), F.col("rid").alias("dst"), F.sqrt("d2").alias("dist"), "rank")


def nn_xy(points: DataFrame, right: DataFrame, right_id: str = "loc_id") -> DataFrame:
    """Nearest row of ``right`` in the xy plane."""
    return knn(points, 1, "xy", right, right_id=right_id).drop("rank")


def nn_xyz(points: DataFrame, right: DataFrame, right_id: str = "pid") -> DataFrame:
    return knn(points, 1, "xyz", right, right_id=right_id).drop("rank")


def ball_lowest(peaks: DataFrame, points: DataFrame, radius: float = 0.2, peak_id: str = "peak_id", deepest: int = 40) -> DataFrame:
    """``cloud_id, peak_id, x, y, z``: the lowest point within ``radius`` (xy) of each peak; peaks without points go.

    A cell of a grid knows its rows' number, box and lowest row. Where that row is within the ball, it answers for its cell;
    of the other cells that the ball may touch, those whose lowest row is not above the best found are halved along both
    axes, again and again. Rows are compared only once the cells left hold no more rows than there are points.
    """
    placed = lambda df: df.filter(reduce(lambda p, q: p & q, [F.col(c).isNotNull() & (F.abs(c) < math.inf) for c in "xy"]))
    rows = placed(points.filter(F.col("z").isNotNull())).select("cloud_id", "pid", *"xyz")
    asked = placed(peaks).select("cloud_id", F.col(peak_id).alias("rid"), *[F.col(a).alias("r" + a) for a in "xy"])
    peak, inside = ["cloud_id", "rid", "rx", "ry"], F.lit(radius * radius)
    side, low, few = radius * WIDER, F.struct("z", "pid", *"xy"), rows.count()
    number = lambda a, level: F.floor(F.col(a) / F.lit(side) * F.lit(2.0**level)).cast("long")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    open_ = asked.withColumn("s", F.explode(steps)).select(*peak, (number("rx", 0) + F.col("s.i")).alias("up_i"), (number("ry", 0) + F.col("s.j")).alias("up_j"))
    found, level = None, 0
    while True:
        up = 1 if level else 0
        cells = rows.groupBy("cloud_id", number("x", level).alias("i"), number("y", level).alias("j")).agg(F.count("*").alias("n"), *[F.min(a).alias("a" + a) for a in "xy"], *[F.max(a).alias("b" + a) for a in "xy"], F.min(low).alias("low"))
        met = open_.select(*peak, "up_i", "up_j").join(cells.withColumns({"up_i": F.shiftright("i", up), "up_j": F.shiftright("j", up)}), ["cloud_id", "up_i", "up_j"])
        met = met.withColumns({"lx": F.col("low.x"), "ly": F.col("low.y")})
        gap = [F.greatest(F.col("a" + a) - F.col("r" + a), F.col("r" + a) - F.col("b" + a), F.lit(0.0)) for a in "xy"]
        near = gap[0] * gap[0] + gap[1] * gap[1] <= inside * WIDER
        met = materialize(met.filter(near).select(*peak, "i", "j", "n", "low", (squared("xy") <= inside).alias("hit")), "ball-cells")
        hits = met.filter("hit").select("cloud_id", "rid", "low")
        last, found = found, materialize((hits if found is None else hits.unionByName(found)).groupBy("cloud_id", "rid").agg(F.min("low").alias("low")), "lowest")
        left = met.filter("not hit").join(found.withColumnRenamed("low", "best"), ["cloud_id", "rid"], "left").filter(F.col("best").isNull() | (F.col("low") < F.col("best")))
        open_, before = materialize(left.select(*peak, "n", "best", F.col("i").alias("up_i"), F.col("j").alias("up_j")), "open"), open_
        discard(met, last, before)
        if level == deepest or (open_.agg(F.sum("n")).first()[0] or 0) <= few:
            break
        level += 1
    at = rows.select("cloud_id", number("x", level).alias("up_i"), number("y", level).alias("up_j"), low.alias("low"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    rest = open_.join(at, ["cloud_id", "up_i", "up_j"]).filter((F.col("best").isNull() | (F.col("low") < F.col("best"))) & (squared("xy") <= inside))
    lowest = found.unionByName(rest.select("cloud_id", "rid", "low")).groupBy("cloud_id", "rid").agg(F.min("low").alias("p"))
    return lowest.select("cloud_id", F.col("rid").alias(peak_id), "p.x", "p.y", "p.z")


def cluster_min_distance(points: DataFrame, pairs: DataFrame, label: str = "label", most: int = 1024) -> DataFrame:
    """``cloud_id, src, dst, d3, d2``: for each pair of clusters its closest points in 3-D, with their xy distance.

    Each cluster's box is halved along every axis, again and again. Of two clusters' cells only those pairs go on whose
    boxes are not farther apart than some two points of the clusters are; once no two cells left hold more than
    ``most`` pairs of points, these are compared. So distances computed grow with the clusters' number, not with the
    square of their size.
    """
    key = ["cloud_id", "label"]
    rows = points.groupBy("cloud_id", F.col(label).alias("label"), *"xyz").agg(F.min("pid").alias("pid"))  # of rows at one place the first counts
    named = pairs.select("cloud_id", "src", "dst").distinct()
    wanted = named.select("cloud_id", F.explode(F.array("src", "dst")).alias("label")).distinct()
    box = rows.groupBy(*key).agg(*[F.min(c).alias("lo" + c) for c in "xyz"], *[(F.max(c) - F.min(c)).alias("w" + c) for c in "xyz"])
    rows = materialize(rows.join(box, key).join(wanted, key, "left_semi"), "cluster-points")
    open_, level = named.withColumns({"sc": F.lit(0).cast("long"), "dc": F.lit(0).cast("long")}), 0
    while True:
        level += 1
        # a cell's number: three bits a level, of the way down to it
        bits = [F.least(F.floor((F.col(c) - F.col("lo" + c)) * (2.0**level) / F.when(F.col("w" + c) > 0, F.col("w" + c)).otherwise(1.0)), F.lit(2**level - 1)).cast("long") for c in "xyz"]
        here = reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + j) for i in range(level) for j, c in enumerate(bits)])
        up = F.lit(0).cast("long") if level == 1 else reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(c, i + 1).bitwiseAND(F.lit(1).cast("long")), 3 * i + j) for i in range(level - 1) for j, c in enumerate(bits)])
        at = rows.withColumns({"cell": here, "up": up})
        cells = materialize(at.groupBy(*key, "cell", "up").agg(F.count("*").alias("n"), *[F.min(c).alias("a" + c) for c in "xyz"], *[F.max(c).alias("b" + c) for c in "xyz"], F.min(F.struct("pid", *"xyz")).alias("p")), "cluster-cells")
        one = lambda side: cells.select("cloud_id", F.col("label").alias(side), F.col("up").alias(side[0] + "c"), F.struct("cell", "n", "p", *["a" + c for c in "xyz"], *["b" + c for c in "xyz"]).alias(side[0]))
        met = open_.join(one("src"), ["cloud_id", "src", "sc"]).join(one("dst"), ["cloud_id", "dst", "dc"])
        apart = [F.greatest(F.col(f"s.a{c}") - F.col(f"d.b{c}"), F.col(f"d.a{c}") - F.col(f"s.b{c}"), F.lit(0.0)) for c in "xyz"]
        some = [F.col(f"s.p.{c}") - F.col(f"d.p.{c}") for c in "xyz"]
        square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
        met = materialize(met.select("cloud_id", "src", "dst", F.col("s.cell").alias("sc"), F.col("d.cell").alias("dc"), (F.col("s.n") * F.col("d.n")).alias("n"), square(apart).alias("least"), square(some).alias("some")), "cell-pairs")
        reach = met.groupBy("cloud_id", "src", "dst").agg(F.min("some").alias("reach"))
        last, open_ = open_, materialize(met.join(reach, ["cloud_id", "src", "dst"]).filter("least <= reach").select("cloud_id", "src", "dst", "sc", "dc", "n"), "open")
        discard(met, cells, last)
        if level == 20 or (open_.agg(F.max("n")).first()[0] or 0) <= most:
            break
        open_ = open_.drop("n")
    side = lambda s: at.select("cloud_id", F.col("label").alias(s), F.col("cell").alias(s[0] + "c"), F.col("pid").alias({"src": "lid", "dst": "rid"}[s]), *[F.col(c).alias({"src": "l", "dst": "r"}[s] + c) for c in "xyz"])
    every = open_.join(side("src"), ["cloud_id", "src", "sc"]).join(side("dst"), ["cloud_id", "dst", "dc"])
    every = every.select("cloud_id", "src", "dst", squared("xyz").alias("q3"), squared("xy").alias("q2"), "lid", "rid")
    best = every.groupBy("cloud_id", "src", "dst").agg(F.min(F.struct("q3", "lid", "rid", "q2")).alias("b"))
    return best.select("cloud_id", "src", "dst", F.sqrt("b.q3").alias("d3"), F.sqrt("b.q2").alias("d2"))


def semi_pair_lookup(pairs: DataFrame, touching: DataFrame) -> DataFrame:
    """``pairs`` with ``touches``."""
    known = touching.select("cloud_id", "src", "dst").distinct().withColumn("touches", F.lit(True))
    return pairs.join(known, ["cloud_id", "src", "dst"], "left").withColumn("touches", F.coalesce("touches", F.lit(False)))


def label_lookup(inverse: DataFrame, labels: DataFrame, default=None) -> DataFrame:
    """Labels of representatives for all points: ``cloud_id, pid, label``."""
    named = labels.select("cloud_id", F.col("pid").alias("rep"), "label")
    out = inverse.join(named, ["cloud_id", "rep"], "left").select("cloud_id", "pid", "label")
    return out if default is None else out.withColumn("label", F.coalesce("label", F.lit(default)))


def head_nn(seconds: DataFrame, heads: DataFrame, bound: float, k: int = 4) -> DataFrame:
    """Branch heads within ``bound`` of the second nodes, ``k`` nearest, not at distance 0."""
    return knn_bounded(seconds, k, bound, "xyz", heads, "node_id", "node_id", apart=True)


def masked_split(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Labelled and unlabelled halves."""
    labelled = F.coalesce(F.col(label), F.lit(0)) > 0
    return df.filter(labelled), df.filter(~labelled)


def base_to_component(bases: DataFrame, components: DataFrame, base_id: str = "loc_id") -> DataFrame:
    """``cloud_id, base_id, label``: the component of the point nearest to each base (``components``: pid, x, y, z, label)."""
    near = knn(bases, 1, "xyz", components, left_id=base_id)
    named = components.select("cloud_id", F.col("pid").alias("dst"), "label")
    return near.join(named, ["cloud_id", "dst"]).select("cloud_id", F.col("src").alias(base_id), "label")
