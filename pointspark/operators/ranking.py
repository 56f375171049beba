"""Ordering, running and window-like operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.shared import materialize


def nms_candidates(tops: DataFrame, threshold: float, rank: str, ident: str) -> DataFrame:
    """``cloud_id, l, r``: pairs of tops that may be near enough to be rivals, each once.

    Radii fall into classes by powers of two, and each class has a grid as wide as two of its tops reach. A top stands in
    the grids of its own class and of all wider ones that occur, and meets the tops of that class in the cells around,
    so one wide top does not widen the cells of the others.
    """
    side = F.struct(F.col(ident).alias("id"), F.col(rank).alias("v"), F.col("radius").alias("r"), "x", "y")
    cls = F.floor(F.log2(F.greatest("radius", F.lit(1e-6)))).cast("int")
    base = tops.filter(F.col("radius").isNotNull()).select("cloud_id", side.alias("s"), cls.alias("c"))
    classes = sorted(row["c"] for row in base.select("c").distinct().collect())  # a row for each power of two
    cell = lambda a: F.floor(F.col("s." + a) / F.greatest(F.pow(F.lit(2.0), F.col("k") + 2) * threshold * (1 + 1e-9), F.lit(1e-6))).cast("long")
    own = base.withColumn("k", F.explode(F.filter(F.array(*[F.lit(c) for c in classes]), lambda k: k >= F.col("c")))) if classes else base.withColumn("k", F.col("c"))
    own = own.select("cloud_id", "k", cell("x").alias("i"), cell("y").alias("j"), F.col("s").alias("l"), "c")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = base.withColumn("k", F.col("c")).withColumn("o", F.explode(steps))
    wide = wide.select("cloud_id", "k", (cell("x") + F.col("o.i")).alias("i"), (cell("y") + F.col("o.j")).alias("j"), F.col("s").alias("r"))
    met = own.join(wide, ["cloud_id", "k", "i", "j"])
    return met.filter((F.col("c") < F.col("k")) | (F.col("l.id") < F.col("r.id"))).select("cloud_id", "l", "r")


def nms(tops: DataFrame, threshold: float = 0.5, by_height: bool = True, ident: str = "loc_id") -> DataFrame:
    """Tops that greedy suppression keeps, highest (or widest) first, ties to the smaller identifier.

    A top suppresses lower ones whose xy distance is at most ``(r1 + r2) * threshold``. Rounds: a top with no
    undecided rival above it stays and removes its rivals below; the test is symmetric, so this equals the
    greedy order. Tops without a radius have no rivals.
    """
    pairs = nms_candidates(tops, threshold, "z" if by_height else "radius", ident)
    dx, dy = (F.col("l." + a) - F.col("r." + a) for a in "xy")
    pairs = pairs.filter(F.sqrt(dx * dx + dy * dy) <= (F.col("l.r") + F.col("r.r")) * threshold)
    first = (F.col("l.v") > F.col("r.v")) | ((F.col("l.v") == F.col("r.v")) & (F.col("l.id") < F.col("r.id")))
    second = (F.col("r.v") > F.col("l.v")) | ((F.col("l.v") == F.col("r.v")) & (F.col("r.id") < F.col("l.id")))
    rivals = pairs.filter(first | second).select("cloud_id", F.when(first, F.col("l.id")).otherwise(F.col("r.id")).alias("a"), F.when(first, F.col("r.id")).otherwise(F.col("l.id")).alias("b"))
    rivals = materialize(rivals.select("cloud_id", "a", "b"), "rivals")  # a beats b
    open_, gone = rivals, None
    while not open_.isEmpty():
        beaten = open_.select("cloud_id", F.col("b").alias("a")).distinct()
        kings = open_.select("cloud_id", "a").distinct().join(beaten, ["cloud_id", "a"], "left_anti")
        lost = materialize(open_.join(kings, ["cloud_id", "a"]).select("cloud_id", "b").distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = open_.join(lost, ["cloud_id", "b"], "left_anti").join(lost.withColumnRenamed("b", "a"), ["cloud_id", "a"], "left_anti").join(kings, ["cloud_id", "a"], "left_anti")
        open_ = materialize(left, "rivals")
    return tops if gone is None else tops.join(gone.select("cloud_id", F.col("b").alias(ident)).distinct(), ["cloud_id", ident], "left_anti").select(*tops.columns)


def _offsets(parts: DataFrame, by: tuple[str, ...], part: str, n: str) -> DataFrame:
    """``parts`` (one row for each ``by`` and ``part``) with ``_before``: what the parts before hold, and the key columns renamed to ``_k...``."""
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*[F.col(c).alias("_k" + c) for c in (*by, part)], F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_before"))


def _beside(rows: DataFrame, offsets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    on = [F.col(c).eqNullSafe(F.col("_k" + c)) for c in keys]
    return rows.join(offsets, on).drop(*["_k" + c for c in keys])


#: Offsets that are broadcast at most.
FEW_OFFSETS = 500_000


def beside_counted(rows: DataFrame, offsets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """As ``_beside``, for written offsets: Spark never broadcasts the rows, whose number a plan does not show, and the offsets only if they are few."""
    offsets = F.broadcast(offsets) if offsets.count() <= FEW_OFFSETS else offsets.hint("merge")
    return _beside(rows, offsets, keys)


def block_offsets(rows: DataFrame, valid: str, order: str, by=("cloud_id",), block: int = 4096) -> DataFrame:
    """Valid rows before each block of ``order``, written."""
    dealt = rows.withColumn("_part", F.floor(F.col(order) / F.lit(block)))
    return materialize(_offsets(dealt.groupBy(*by, "_part").agg(F.sum(F.col(valid).cast("long")).alias("_n")), tuple(by), "_part", "_n"), "offsets")


def order_by_distance_desc(nodes: DataFrame, dist: str = "dist", ident: str = "node_id", parts: int = 256) -> DataFrame:
    """Processing order within a cloud: farthest first, ties by identifier.

    Rows are dealt to ranges of distance by approximate quantiles; a place is the rows of the ranges before plus the
    place in the own range, so a cloud is spread over tasks.
    """
    marks = nodes.groupBy("cloud_id").agg(F.percentile_approx(dist, [i / parts for i in range(1, parts)], 1000).alias("_marks")).withColumnRenamed("cloud_id", "_kcloud_id")
    dealt = _beside(nodes, marks, ("cloud_id",)).withColumn("_part", F.expr(f"size(filter(_marks, m -> m > {dist}))")).drop("_marks")
    offsets = _offsets(dealt.groupBy("cloud_id", "_part").agg(F.count("*").alias("_n")), ("cloud_id",), "_part", "_n")
    placed = _beside(dealt, offsets, ("cloud_id", "_part"))
    within = Window.partitionBy("cloud_id", "_part").orderBy(F.desc(dist), ident)
    return placed.withColumn("seq", (F.col("_before") + F.row_number().over(within) - 1).cast("int")).drop("_part", "_before")


def argmin_over_targets(distances: DataFrame, by: str = "node", dist: str = "dist", target: str = "target") -> DataFrame:
    """Nearest target of each node, the first of equals."""
    return distances.groupBy("cloud_id", by).agg(F.min(F.struct(dist, target)).alias("b")).select("cloud_id", by, f"b.{target}", f"b.{dist}")


def median_filter_3(nodes: DataFrame, value: str = "radius", by=("cloud_id", "path_id"), order: str = "seq") -> DataFrame:
    """Median of a node and its two neighbours, 0 beyond the ends; paths of three nodes or fewer stay."""
    along = Window.partitionBy(*by).orderBy(order)
    three = F.array_sort(F.array(F.lag(value, 1, 0.0).over(along), F.col(value), F.lead(value, 1, 0.0).over(along)))
    n = F.count("*").over(Window.partitionBy(*by))
    return nodes.withColumn(value, F.when(n > 3, F.element_at(three, 2)).otherwise(F.col(value)))


def running_index(rows: DataFrame, valid: str, order: str, by=("cloud_id",), block: int = 4096, offsets: DataFrame | None = None) -> DataFrame:
    """New 0-based index of valid rows by an integer order (the count of valid rows up to a row, less one).

    Counted for blocks of ``order`` first (or before: ``block_offsets``), so a group is spread over tasks.
    """
    dealt = rows.withColumn("_part", F.floor(F.col(order) / F.lit(block)))
    offsets = block_offsets(rows, valid, order, by, block) if offsets is None else offsets
    upto = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = beside_counted(dealt, offsets, (*by, "_part"))
    return placed.withColumn("new_index", F.col("_before") + F.sum(F.col(valid).cast("long")).over(upto) - 1).drop("_part", "_before")


def segment_vectors(nodes: DataFrame, by=("cloud_id", "path_id"), order: str = "seq") -> DataFrame:
    """Difference to the node before and its unit direction; none for the first node."""
    along = Window.partitionBy(*by).orderBy(order)
    out = nodes.withColumns({"d" + c: F.col(c) - F.lag(c).over(along) for c in "xyz"})
    out = out.withColumn("length", F.sqrt(sum((F.col("d" + c) * F.col("d" + c) for c in "xyz"), F.lit(0.0))))
    return out.withColumns({"u" + c: F.when(F.col("length") > 0, F.col("d" + c) / F.col("length")) for c in "xyz"})


def _grown(radius: float | None, growth: float, steps: int) -> float | None:
    """``radius`` times ``growth``, ``steps`` times over (not by a power, whose last digit may differ)."""
    for _ in range(steps if radius is not None else 0):
        last, radius = radius, growth * radius
        if radius == last or radius != radius:
            break
    return radius


def _least(a: float | None, b: float | None) -> float | None:
    """The smaller as SQL has it: nulls are passed over and NaN is the greatest."""
    if a is None or b is None:
        return b if a is None else a
    return b if a != a or b < a else a


def _constrained(radii: list[float | None], growth: float, before: float | None) -> list[float | None]:
    out = []
    for r in radii:
        before = _least(r, None if before is None else growth * before)
        out.append(before)
    return out


def constrain_radii(nodes: DataFrame, value: str = "radius", by=("cloud_id", "path_id"), order: str = "seq", growth: float = 1.1, block: int = 4096) -> DataFrame:
    """Along a path, no radius over ``growth`` times the (constrained) one before it.

    A constrained radius is the least of the path's radii up to it, each grown once for every step since. So blocks of
    ``order`` are folded by themselves, what enters a block is the least of what the blocks before it leave, and the
    blocks are folded again from there: linear in the nodes, and no task holds a path.
    """
    key, columns = [*by, "_part"], nodes.columns
    typed = [f.dataType.simpleString() for f in (nodes.schema[c] for c in by)]
    named = ", ".join(f"{c} {t}" for c, t in zip(by, typed, strict=True)) + ", _part long"
    dealt = nodes.withColumns({value: F.col(value).cast("double"), "_part": F.floor(F.col(order) / F.lit(block)).cast("long")})
    dealt = materialize(dealt, "path-nodes")

    def leaves(group: pa.Table) -> pa.Table:
        radii = group.sort_by(order).column(value).to_pylist()
        return group.select(key).slice(0, 1).append_column("_left", pa.array(_constrained(radii, growth, None)[-1:], pa.float64())).append_column("_n", pa.array([len(radii)], pa.int64()))

    def enters(group: pa.Table) -> pa.Table:
        group, before, out = group.sort_by("_part"), None, []
        for left, n in zip(group.column("_left").to_pylist(), group.column("_n").to_pylist(), strict=True):
            out.append(before)
            before = _least(left, _grown(before, growth, n))
        return group.select(key).append_column("_before", pa.array(out, pa.float64()))

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        radii = _constrained(group.column(value).to_pylist(), growth, group.column("_before")[0].as_py())
        return group.set_column(group.schema.get_field_index(value), value, pa.array(radii, pa.float64())).select(columns)

    left = dealt.select(*key, order, value).groupBy(*key).applyInArrow(leaves, f"{named}, _left double, _n long")
    before = left.groupBy(*by).applyInArrow(enters, f"{named}, _before double")
    return _beside(dealt, before.withColumnsRenamed({c: "_k" + c for c in key}), tuple(key)).groupBy(*key).applyInArrow(fold, dealt.drop("_part").schema)


def farthest_reachable(distances: DataFrame, dist: str = "dist", ident: str = "node") -> DataFrame:
    ok = distances.filter(F.col(dist).isNotNull() & ~F.isnan(dist) & (F.abs(F.col(dist)) < float("inf")))
    return ok.groupBy("cloud_id").agg(F.max_by(F.struct(ident, dist), F.struct(F.col(dist), -F.col(ident))).alias("b")).select("cloud_id", f"b.{ident}", f"b.{dist}")


def moving_average(rows: DataFrame, value: str, width: int, by=("cloud_id", "path_id"), order: str = "seq") -> DataFrame:
    """Mean of ``width`` rows; only places with a full window."""
    along = Window.partitionBy(*by).orderBy(order)
    out = rows.withColumn("mean", F.avg(value).over(along.rowsBetween(1 - width, 0))).withColumn("_at", F.row_number().over(along))
    return out.filter(F.col("_at") >= width).drop("_at")


def first_occurrence(rows: DataFrame, *by: str, ident: str = "pid") -> DataFrame:
    return rows.groupBy(*by).agg(F.min(ident).alias("first"))


def lowest_start(segments: DataFrame, ident: str = "segment") -> DataFrame:
    """The lowest stem segment of each cloud."""
    stems = segments.filter(F.col("is_stem") > 0)
    return stems.groupBy("cloud_id").agg(F.min_by(ident, F.struct("z", ident)).alias("start"))


def topk_neighbours(pairs: DataFrame, k: int, by=("cloud_id", "src"), dist: str = "dist", ident: str = "dst") -> DataFrame:
    """The ``k`` nearest by ``dist``, ties by the ``rank`` of a search if the pairs have one (unequal squares may have equal roots), then to the smaller ``ident``."""
    order = Window.partitionBy(*by).orderBy(dist, *[c for c in ("rank",) if c in pairs.columns], ident)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
