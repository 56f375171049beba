"""Rasters as sparse rows ``cloud_id, row, col, value``; an absent row is an empty cell."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.operators.aggregates import cell_min
from pointspark.operators.filters import drop_non_finite, filter_ground
from pointspark.operators.graph import connected_components
from pointspark.operators.grid import buffered_tiles, extent, raster_key_upperleft, raster_to_points, tile_merge_mean
from pointspark.operators.interpolation import fill_triangles
from pointspark.shared import materialize

#: Offsets of a disk of radius 5 cells.
DISK = [(a, b) for a, b in product(range(-5, 6), repeat=2) if a * a + b * b <= 25]


def _offsets(cells: list[tuple[int, int]]):
    return F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in cells]))


def median_disk(raster: DataFrame, by=("cloud_id",), radius: int = 5) -> DataFrame:
    """Median over the disk around each occupied cell, of the occupied cells in it."""
    cells = [(a, b) for a, b in product(range(-radius, radius + 1), repeat=2) if a * a + b * b <= radius * radius]
    keys = [*by, "row", "col"]
    spread = raster.withColumn("o", _offsets(cells)).select(*by, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "value")
    medians = spread.groupBy(*keys).agg(F.median("value").alias("value"))
    return medians.join(raster.select(*keys), keys, "left_semi")


def fill_gaps(raster: DataFrame, method: str = "idw", radius: int = 5, shape: DataFrame | None = None, by=("cloud_id",), reach: int = 64) -> DataFrame:
    """``raster`` with empty cells near occupied ones filled.

    ``none`` leaves them, ``idw`` weighs occupied cells within ``radius`` by 1 / squared distance, ``nearest``
    takes the nearest (ties to the smaller row, then column). ``linear`` and ``cubic`` interpolate over the Delaunay
    triangles of the occupied cells; cells outside of their hull stay empty, as do cells in gaps wider than
    ``reach`` (see ``interpolation``). ``shape`` (by, nrow, ncol) bounds the cells.
    """
    if method == "none":
        return raster
    if method in ("linear", "cubic"):
        return _over_triangles(raster, method == "cubic", shape, by, reach)
    cells = [(a, b) for a, b in product(range(-radius, radius + 1), repeat=2) if 0 < a * a + b * b <= radius * radius]
    keys = [*by, "row", "col"]
    q = F.col("o.a") * F.col("o.a") + F.col("o.b") * F.col("o.b")
    spread = raster.withColumn("o", _offsets(cells)).select(*by, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), q.alias("q"), "value", F.col("row").alias("fr"), F.col("col").alias("fc"))
    if shape is not None:
        spread = spread.join(shape, list(by)).filter("row >= 0 and row < nrow and col >= 0 and col < ncol")
    if method == "idw":
        filled = spread.groupBy(*keys).agg((F.sum(F.col("value") / F.col("q")) / F.sum(F.lit(1.0) / F.col("q"))).alias("value"))
    elif method == "nearest":
        filled = spread.groupBy(*keys).agg(F.min_by("value", F.struct("q", "fr", "fc")).alias("value"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return raster.select(*keys, "value").unionByName(filled.join(raster.select(*keys), keys, "left_anti").select(*keys, "value"))


def _over_triangles(raster: DataFrame, cubic: bool, shape: DataFrame | None, by, reach: int) -> DataFrame:
    named = raster.select(*by, "row", "col", "value").withColumn("g", F.to_json(F.struct(*by)))
    if shape is None:
        bounds = named.groupBy("g").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))
    else:
        bounds = shape.select(F.to_json(F.struct(*by)).alias("g"), F.lit(0).alias("top"), F.lit(0).alias("left"), (F.col("nrow") - 1).alias("bottom"), (F.col("ncol") - 1).alias("right"))
    named = materialize(named.join(bounds, "g"), "raster")
    filled = fill_triangles(named.drop(*by), cubic, reach)
    kinds = ", ".join(f"`{c}` {raster.schema[c].dataType.simpleString()}" for c in by)
    keys = F.from_json("g", kinds)
    return named.select(*by, "row", "col", "value").unionByName(filled.select(*[keys[c].alias(c) for c in by], "row", "col", "value"))


def raster_shape(points: DataFrame, resolution: float) -> DataFrame:
    e = extent(points, ("x", "y"))
    return e.select("cloud_id", (F.floor((F.col("max_y") - F.col("min_y")) / resolution) + 1).alias("nrow"), (F.floor((F.col("max_x") - F.col("min_x")) / resolution) + 1).alias("ncol"))


def dtm(points: DataFrame, resolution: float = 1.0, tile: float = 50.0, buffer: float = 5.0, fill: str = "cubic", smooth: bool = True) -> DataFrame:
    """``cloud_id, row, col, x, y, z``: ground raster from buffered tiles.

    Ground points to tiles, lowest z of each cell, gaps filled, median over a disk, lower-left corners as points;
    overlapping tiles are averaged on the cloud's grid.
    """
    ground = drop_non_finite(filter_ground(points), "z")
    frame = extent(ground, ("x", "y")).withColumnsRenamed({"min_x": "gx", "min_y": "gy"}).select("cloud_id", "gx", "gy")
    tiles = buffered_tiles(ground.select("cloud_id", "x", "y", "z"), tile, buffer)
    own = tiles.groupBy("cloud_id", "ti", "tj").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    own = materialize(own, "tiles")
    by = ("cloud_id", "ti", "tj")
    keyed = tiles.join(own, list(by)).withColumns({"row": F.floor((F.col("y") - F.col("ymin")) / resolution), "col": F.floor((F.col("x") - F.col("xmin")) / resolution)})
    cells = cell_min(keyed, by=(*by, "row", "col"))
    shape = own.select(*by, (F.floor((F.col("ymax") - F.col("ymin")) / resolution) + 1).alias("nrow"), (F.floor((F.col("xmax") - F.col("xmin")) / resolution) + 1).alias("ncol"))
    cells = materialize(fill_gaps(cells, fill, shape=shape, by=by), "cells")
    if smooth:
        cells = median_disk(cells, by)
    placed = cells.join(own, list(by)).join(frame, "cloud_id").withColumns({"x": F.col("xmin") + F.col("col") * resolution, "y": F.col("ymin") + F.col("row") * resolution})
    placed = placed.select("cloud_id", F.floor((F.col("y") - F.col("gy")) / resolution).alias("row"), F.floor((F.col("x") - F.col("gx")) / resolution).alias("col"), "x", "y", F.col("value").alias("z"), F.struct("ti", "tj", F.col("row").alias("r"), F.col("col").alias("c")).alias("seq"))
    return tile_merge_mean(drop_non_finite(placed, "z"))


def dtm_stats(points: DataFrame, resolution: float = 1.0, fill: str = "none", frame: DataFrame | None = None, cls: str = "treefilter") -> DataFrame:
    """``cloud_id, row, col, x, y, z``: lowest ground z of each cell seen from (xmin, ymax), at cell centres."""
    ground = filter_ground(points, cls)
    keyed = raster_key_upperleft(ground, resolution, frame if frame is not None else ground)
    corner = extent(frame if frame is not None else ground, ("x", "y")).select("cloud_id", F.col("min_x").alias("xmin"), F.col("max_y").alias("ymax"))
    cells = fill_gaps(cell_min(keyed), fill).join(corner, "cloud_id")
    return drop_non_finite(raster_to_points(cells, resolution, centre=True), "z")


def label_image(cells: DataFrame) -> DataFrame:
    """``cloud_id, label, row, col, n``: centroids of 8-connected regions of occupied cells; label = least cell key."""
    side = 1 << 24
    keyed = cells.select("cloud_id", "row", "col", (F.col("row") * side + F.col("col")).alias("cell")).distinct()
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]
    moved = keyed.withColumn("o", _offsets(half)).select("cloud_id", F.col("cell").alias("src"), ((F.col("row") + F.col("o.a")) * side + F.col("col") + F.col("o.b")).alias("dst"))
    edges = moved.join(keyed.select("cloud_id", F.col("cell").alias("dst")), ["cloud_id", "dst"], "left_semi")
    labels = connected_components(keyed, materialize(edges, "image-edges"), "cell")
    named = keyed.join(labels, ["cloud_id", "cell"])
    return named.groupBy("cloud_id", "label").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), F.count("*").alias("n"))


def treeloc_stem_peaks(mask: DataFrame, points: DataFrame, resolution: float, radius: float = 0.2, threshold: float = 0.1) -> DataFrame:
    """Tree bases from a per-column stem probability: threshold, regions, centroids, lowest point nearby.

    ``mask``: cloud_id, row, col, value, xmin, ymin (cell (row, col) spans resolution from there).
    """
    from pointspark.operators.spatial import ball_lowest

    hot = mask.filter(F.col("value") > threshold)
    corner = hot.groupBy("cloud_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"))
    regions = label_image(hot).join(corner, "cloud_id")
    peaks = regions.select("cloud_id", F.col("label").alias("peak_id"), (F.col("xmin") + F.col("col") * resolution).alias("x"), (F.col("ymin") + F.col("row") * resolution).alias("y"))
    return ball_lowest(peaks, points, radius)
