"""Tiling, voxels and raster keys: grouping keys computed from coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.operators.filters import in_block_bounds, with_minima
from pointspark.schema import XYZ


def extent(df: DataFrame, cols=XYZ) -> DataFrame:
    return df.groupBy("cloud_id").agg(*[f(c).alias(n + c) for c in cols for f, n in ((F.min, "min_"), (F.max, "max_"))])


def _cell(c: str, size: float, origin: Column | None = None) -> Column:
    return F.floor(((F.col(c) - origin) if origin is not None else F.col(c)) / F.lit(float(size)))


def sliding_blocks(df: DataFrame, block: tuple[float, ...], overlap: float = 0.1) -> DataFrame:
    """``df`` with ``block_id``, a row for each overlapping block a point is in, each once.

    Two or three sides may be given (two leave z whole). Overlap must be below one half, so that a point is in two
    blocks of an axis at most. Every axis has one block at least, however short.
    """
    axes = XYZ[: len(block)]
    out = df.join(extent(df, axes), "cloud_id")
    for a, side in zip(axes, block, strict=True):
        stride = side * (1 - overlap)
        out = out.withColumn("n" + a, F.greatest(F.floor((F.col("max_" + a) - F.col("min_" + a) - side) / stride) + 2, F.lit(1)))
        at = F.floor((F.col(a) - F.col("min_" + a)) / stride)
        top = F.col("n" + a) - 1
        both = F.array_distinct(F.array(*[F.greatest(F.least(x, top), F.lit(0)) for x in (at, at - 1)]))
        out = out.withColumn("b" + a, F.explode(both))
        start = F.col("min_" + a) + F.col("b" + a) * stride
        out = out.filter((F.col(a) >= start) & (F.col(a) < start + side))
    ident = F.lit(0).cast("long")
    for a in axes:
        ident = ident * F.col("n" + a) + F.col("b" + a)
    return out.select(*df.columns, ident.cast("long").alias("block_id"))


def grid_blocks(df: DataFrame, resolution: tuple[float, float], size: tuple[int, int]) -> DataFrame:
    """``df`` with ``bi, bj`` of non-overlapping blocks of ``size`` voxels."""
    low = with_minima(df, ("x", "y"))
    return low.select(*df.columns, *[F.floor((F.col(a) - F.col("min_" + a)) / F.lit(float(r)) / F.lit(n)).alias(o) for a, r, n, o in zip("xy", resolution, size, ("bi", "bj"), strict=True)])


def coarse_tiles(df: DataFrame, tile: float = 5.0) -> DataFrame:
    return grid_blocks(df, (tile, tile), (1, 1))


def buffered_tiles(df: DataFrame, tile: float, buffer: float) -> DataFrame:
    """``df`` with ``ti, tj``, a row for each tile whose square, widened by ``buffer``, holds the point (closed ends)."""
    out = df.join(extent(df, ("x", "y")), "cloud_id")
    for a, t in (("x", "ti"), ("y", "tj")):
        rel = F.col(a) - F.col("min_" + a)
        last = F.ceil((F.col("max_" + a) - F.col("min_" + a)) / tile) - 1
        lo = F.greatest(F.ceil((rel - buffer) / tile) - 1, F.lit(0))
        hi = F.least(F.floor((rel + buffer) / tile), last)
        out = out.filter(lo <= hi).withColumn(t, F.explode(F.sequence(lo, hi)))
    return out.select(*df.columns, "ti", "tj")


def block_voxelize(blocks: DataFrame, resolution: tuple[float, float, float], size: tuple[int, int, int]) -> DataFrame:
    """``i, j, k, voxel`` of each block point from the block's own minimum (z too); points outside ``size`` go."""
    low = with_minima(blocks, by=("cloud_id", "block_id"))
    ijk = low.select(*blocks.columns, *[_cell(a, r, F.col("min_" + a)).alias(o) for a, r, o in zip(XYZ, resolution, "ijk", strict=True)])
    inside = in_block_bounds(ijk, size)
    return inside.withColumn("voxel", F.col("i") * (size[1] * size[2]) + F.col("j") * size[2] + F.col("k"))


def voxels(voxelized: DataFrame) -> DataFrame:
    """Occupied voxels of each block; the join back on (cloud_id, block_id, voxel) is the inverse."""
    return voxelized.groupBy("cloud_id", "block_id", "voxel", "i", "j", "k").agg(F.count("*").alias("n"))


def voxel_key(df: DataFrame, resolution: float, origin: str = "zero") -> DataFrame:
    """``df`` with ``i, j, k``; the origin is 0, the cloud's minimum, or (ymax, xmin, zmin)."""
    if origin == "zero":
        return df.withColumns({o: _cell(a, resolution) for a, o in zip(XYZ, "ijk", strict=True)})
    low = df.join(extent(df), "cloud_id")
    if origin == "min":
        keys = {o: _cell(a, resolution, F.col("min_" + a)) for a, o in zip(XYZ, "ijk", strict=True)}
    else:
        keys = {"i": F.floor((F.col("max_y") - F.col("y")) / resolution), "j": _cell("x", resolution, F.col("min_x")), "k": _cell("z", resolution, F.col("min_z"))}
    return low.withColumns(keys).select(*df.columns, "i", "j", "k")


def decimate(df: DataFrame, resolution: float, origin: str = "zero") -> tuple[DataFrame, DataFrame]:
    """One point per voxel, the first by ``pid``, and the inverse ``cloud_id, pid, rep``; resolution 0 keeps all."""
    if resolution == 0:
        return df, df.select("cloud_id", "pid", F.col("pid").alias("rep"))
    keyed = voxel_key(df, resolution, origin)
    firsts = keyed.groupBy("cloud_id", "i", "j", "k").agg(F.min("pid").alias("rep"))
    inverse = keyed.join(firsts, ["cloud_id", "i", "j", "k"]).select(*df.columns, "rep")
    return inverse.filter("pid = rep").select(*df.columns), inverse.select("cloud_id", "pid", "rep")


def raster_key_lowerleft(df: DataFrame, resolution: float) -> DataFrame:
    """``row, col`` from (xmin, ymin); every point has a cell."""
    low = with_minima(df, ("x", "y"))
    return low.select(*df.columns, _cell("y", resolution, F.col("min_y")).alias("row"), _cell("x", resolution, F.col("min_x")).alias("col"))


def raster_key_upperleft(df: DataFrame, resolution: float, frame: DataFrame | None = None) -> DataFrame:
    """``row, col, xmin, ymax`` from (xmin, ymax) of ``frame`` (its extent), far edges beyond the shape dropped."""
    keyed = df.join(extent(frame if frame is not None else df, ("x", "y")), "cloud_id")
    keyed = keyed.withColumns({"row": F.floor((F.col("max_y") - F.col("y")) / resolution), "col": _cell("x", resolution, F.col("min_x"))})
    rows, cols = (F.ceil((F.col("max_" + a) - F.col("min_" + a)) / resolution) for a in "yx")
    inside = keyed.filter((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    return inside.select(*df.columns, "row", "col", F.col("min_x").alias("xmin"), F.col("max_y").alias("ymax"))


def raster_to_points(raster: DataFrame, resolution: float, centre: bool, value: str = "value") -> DataFrame:
    """Cells as points: the centre seen from (xmin, ymax), or the lower-left corner seen from (xmin, ymin)."""
    if centre:
        return raster.select("cloud_id", "row", "col", (F.col("xmin") + (F.col("col") + 0.5) * resolution).alias("x"), (F.col("ymax") - (F.col("row") + 0.5) * resolution).alias("y"), F.col(value).alias("z"))
    return raster.select("cloud_id", "row", "col", (F.col("xmin") + F.col("col") * resolution).alias("x"), (F.col("ymin") + F.col("row") * resolution).alias("y"), F.col(value).alias("z"))


def mosaic_patches(cells: DataFrame, order: str = "block_id", value: str = "value") -> DataFrame:
    """One image of overlapping patches, ``cloud_id, i, j, value``: the later patch overwrites."""
    return cells.groupBy("cloud_id", "i", "j").agg(F.max_by(value, order).alias("value"))


def tile_merge_mean(cells: DataFrame, order: str = "seq") -> DataFrame:
    """Tile outputs on the global grid: mean z, and x, y of the first by ``order``."""
    first = F.min_by(F.struct("x", "y"), order)
    return cells.groupBy("cloud_id", "row", "col").agg(F.avg("z").alias("z"), first.alias("p")).select("cloud_id", "row", "col", "p.x", "p.y", "z")
