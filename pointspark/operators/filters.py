"""Predicates, projections and guards on clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointspark.operators.ranks import dense_ranks
from pointspark.schema import XYZ, require_columns


def with_minima(df: DataFrame, cols=XYZ, by=("cloud_id",), prefix: str = "min_") -> DataFrame:
    """``df`` with the group's minima; the aggregate has one row per group and is joined back."""
    low = df.groupBy(*by).agg(*[F.min(c).alias(prefix + c) for c in cols])
    return df.join(low, list(by))


def shift_to_origin(df: DataFrame, cols=XYZ) -> DataFrame:
    """Coordinates less their cloud's minimum on each axis."""
    low = with_minima(df, cols)
    return low.select(*[(F.col(c) - F.col("min_" + c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def filter_above_ground(df: DataFrame) -> DataFrame:
    return require_columns(df, "treefilter", producer="component_filter").filter("treefilter > 1")


def filter_ground(df: DataFrame, cls: str = "treefilter") -> DataFrame:
    return require_columns(df, cls).filter(F.col(cls) <= 1)


def filter_stem(df: DataFrame) -> DataFrame:
    return require_columns(df, "stemcls", producer="component_filter").filter("stemcls > 1")


def filter_branch(df: DataFrame) -> DataFrame:
    """Wood points if the cloud has been classified, else all."""
    return df.filter("branchcls > 1") if "branchcls" in df.columns else df


def filter_confidence(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.filter(F.col("conf") > threshold)


def filter_min_radius(components: DataFrame, min_radius: float) -> DataFrame:
    """Strictly wider components, by their median radius."""
    return components.filter(F.col("radius") > min_radius)


def scatter_back(cloud: DataFrame, values: DataFrame, name: str, default=0) -> DataFrame:
    """A subset's result for every point, ``default`` for the others."""
    return cloud.join(values.select("cloud_id", "pid", name), ["cloud_id", "pid"], "left").withColumn(name, F.coalesce(name, F.lit(default)))


def tile_height_cut(df: DataFrame, cutoff: float = 1.0, tile: float = 5.0) -> DataFrame:
    """In each ``tile`` m square, points up to ``cutoff`` of its height range."""
    low = with_minima(df, ("x", "y"))
    for a in "xy":
        low = low.withColumn("t" + a, F.floor((F.col(a) - F.col("min_" + a)) / tile))
    # aggregate and join: a Window would bring a crowded tile into one task
    span = low.groupBy("cloud_id", "tx", "ty").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    cut = low.join(span, ["cloud_id", "tx", "ty"]).filter((F.col("z") - F.col("z0")) <= (F.col("z1") - F.col("z0")) * cutoff)
    return cut.select(*df.columns)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def drop_non_finite(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols or ("z",):
        df = df.filter(finite(c))
    return df


def in_block_bounds(df: DataFrame, size: tuple[int, int, int], cols=("i", "j", "k")) -> DataFrame:
    for c, n in zip(cols, size, strict=True):
        df = df.filter((F.col(c) >= 0) & (F.col(c) < n))
    return df


def loc_in_tile(block_points: DataFrame, locations: DataFrame, bucket: float = 8.0) -> DataFrame:
    """``cloud_id, block_id, loc_id`` for locations strictly inside a block's bounding box (x, y and z).

    The box is dealt to square buckets, so this is an equi-join with a residual predicate.
    """
    box = block_points.groupBy("cloud_id", "block_id").agg(*[f(c).alias(n + c) for c in XYZ for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    for a in "xy":
        box = box.withColumn("b" + a, F.explode(F.sequence(F.floor(F.col("lo_" + a) / bucket), F.floor(F.col("hi_" + a) / bucket))))
    at = locations.withColumns({"b" + a: F.floor(F.col(a) / bucket) for a in "xy"})
    joined = at.join(box, ["cloud_id", "bx", "by"])
    for c in XYZ:
        joined = joined.filter((F.col(c) > F.col("lo_" + c)) & (F.col(c) < F.col("hi_" + c)))
    return joined.select("cloud_id", "block_id", "loc_id")


def normalize_class(df: DataFrame, cls: str = "stemcls") -> DataFrame:
    """Class less the cloud's smallest class; taken before any filter."""
    low = df.groupBy("cloud_id").agg(F.min(cls).alias("_low"))
    return df.join(low, "cloud_id").withColumn(cls, F.col(cls) - F.col("_low")).drop("_low")


def compact_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Labels renumbered 0.. in sorted order within a cloud; ranks are taken over distinct labels only."""
    ranks = dense_ranks(df, "cloud_id", label, "_rank")
    return df.join(ranks, ["cloud_id", label], "left").withColumn(label, F.col("_rank")).drop("_rank").select(*df.columns)


def block_count(df: DataFrame, resolution_cm: float, block: float) -> DataFrame:
    """Number of blocks a cloud takes in xy; an axis shorter than a block gives 0."""
    side = resolution_cm * 0.01 * block
    per = [F.floor((F.max(a) - F.min(a)) / F.lit(side)) for a in "xy"]
    return df.groupBy("cloud_id").agg((per[0] * per[1]).cast("long").alias("n_blocks"))


def guard_block_count(df: DataFrame, resolution_cm: float, block: float, most: int = 600, confirm=None) -> DataFrame:
    """``df``; asks ``confirm(n)`` (or raises) for clouds of more than ``most`` blocks."""
    for r in block_count(df, resolution_cm, block).filter(F.col("n_blocks") > most).collect():  # a row per cloud
        if confirm is None or not confirm(r["n_blocks"]):
            raise ValueError(f"{r['cloud_id']}: {r['n_blocks']} blocks, more than {most}")
    return df


def point_count(df: DataFrame) -> DataFrame:
    return df.groupBy("cloud_id").agg(F.count("*").alias("n_points"))


def guard_min_points(df: DataFrame, least: int = 10_000, confirm=None) -> DataFrame:
    for r in point_count(df).filter(F.col("n_points") < least).collect():  # a row per cloud
        if confirm is None or not confirm(r["n_points"]):
            raise ValueError(f"{r['cloud_id']}: {r['n_points']} points, fewer than {least}")
    return df


def apply_offsets(df: DataFrame, resolution: tuple[float, ...], offsets: tuple[str, ...] = ("dx", "dy")) -> DataFrame:
    """Coordinates moved by predicted offsets, given in voxels."""
    return df.withColumns({c: F.col(c) + F.col(o) * r for c, o, r in zip(XYZ, offsets, resolution, strict=False)})


def preserve_existing(df: DataFrame, own: str = "treeoff", predicted: str = "pred") -> DataFrame:
    return df.withColumn(predicted, F.when(F.col(own) > 0, F.col(own)).otherwise(F.col(predicted)))


def noise_relabel(df: DataFrame, size: str = "component", cls: str = "stemcls") -> DataFrame:
    """2 for stem points of a component that was kept, 1 for all others."""
    return df.withColumn(cls, F.when((F.col(cls) > 1) & (F.col(size) > 0), 2).otherwise(1))
