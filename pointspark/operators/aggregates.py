"""Grouped reductions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_min(keyed: DataFrame, value: str = "z", by=("cloud_id", "row", "col")) -> DataFrame:
    return keyed.groupBy(*by).agg(F.min(value).alias("value"))


def cell_mean(keyed: DataFrame, value: str = "z", by=("cloud_id", "row", "col")) -> DataFrame:
    return keyed.groupBy(*by).agg(F.avg(value).alias("value"))


def component_median(df: DataFrame, value: str = "radius", label: str = "label") -> DataFrame:
    return df.groupBy("cloud_id", label).agg(F.median(value).alias(value))


def component_centroid(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy("cloud_id", label).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n"))


def mode_positive(df: DataFrame, label: str, by: tuple[str, ...]) -> DataFrame:
    """The most frequent label above 0 of each group, else 0; ties go to the smallest label."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    best = F.max_by(F.when(F.col(label) > 0, F.col(label)), F.when(F.col(label) > 0, F.struct(F.col("_n"), -F.col(label))))
    return counts.groupBy(*by).agg(F.coalesce(best, F.lit(0)).cast("long").alias("mode"))


def component_size(df: DataFrame, least: int, label: str = "label") -> DataFrame:
    """``df`` with ``component``: the size of the row's component, 0 below ``least``."""
    size = df.groupBy("cloud_id", label).agg(F.count("*").alias("_n"))
    return df.join(size, ["cloud_id", label]).withColumn("component", F.when(F.col("_n") >= least, F.col("_n")).otherwise(0)).drop("_n")


def segment_stem_flag(df: DataFrame, segment: str = "segment", flag: str = "stemcls") -> DataFrame:
    return df.groupBy("cloud_id", segment).agg(F.max(flag).alias("is_stem"))


def overlap_or(votes: DataFrame, flag: str = "above") -> DataFrame:
    """2 where any overlapping block says so, else 1."""
    return votes.groupBy("cloud_id", "pid").agg((F.bool_or(flag).cast("int") + 1).alias("label"))


def overlap_last(cloud: DataFrame, votes: DataFrame, num_classes: int, order: str = "block_id") -> DataFrame:
    """The label of the last block, ``num_classes - 1`` for points no block visited."""
    last = votes.groupBy("cloud_id", "pid").agg(F.max_by("label", order).alias("label"))
    return cloud.select("cloud_id", "pid").join(last, ["cloud_id", "pid"], "left").withColumn("label", F.coalesce("label", F.lit(num_classes - 1)))


def seen_mask(cloud: DataFrame, votes: DataFrame) -> DataFrame:
    """Binary labels; points no voxel ever held are above ground (2)."""
    return cloud.select("cloud_id", "pid").join(overlap_or(votes), ["cloud_id", "pid"], "left").withColumn("label", F.coalesce("label", F.lit(2)))


def argmin_row(df: DataFrame, by: tuple[str, ...], value: str = "z", ident: str = "pid") -> DataFrame:
    """The row with the least ``value`` of each group, ties to the smaller identifier."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(value, ident)).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct() if cols else df.distinct()


def voxel_mean_flag(voxelized: DataFrame, value: str = "stemoff") -> DataFrame:
    return voxelized.groupBy("cloud_id", "block_id", "voxel").agg(F.avg((F.col(value) > 0).cast("int")).alias("mean_flag"))


def segment_count(df: DataFrame, segment: str = "segment") -> DataFrame:
    return df.groupBy("cloud_id").agg(F.countDistinct(segment).alias("n_segments"), F.count("*").alias("n_points"))


def multi_base_components(based: DataFrame, label: str = "label") -> DataFrame:
    """Components with more than one base (rows of ``based`` are bases)."""
    return based.groupBy("cloud_id", label).agg(F.count("*").alias("n_bases")).filter("n_bases > 1")


def hull_corners(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the convex hull in ring order, by a monotone chain."""
    pts = np.unique(np.column_stack((x, y)), axis=0)
    if len(pts) < 3:
        return pts[:, 0], pts[:, 1]

    def half(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(pts) + half(pts[::-1]))
    return ring[:, 0], ring[:, 1]


def hull_area_of(x: np.ndarray, y: np.ndarray) -> float:
    x, y = hull_corners(x, y)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2) if len(x) > 2 else 0.0


def hull_area(df: DataFrame, label: str = "itc", least: int = 7, part_rows: int = 50_000) -> DataFrame:
    """``cloud_id, label, area`` of the xy convex hull, 0 below ``least`` points.

    A group's points are dealt to parts of about ``part_rows`` by a hash and each part is cut to its own hull first: the
    hull of the hulls' corners is the hull of all points, and no group meets in one task whole.
    """
    kind = dict(df.dtypes)[label]

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = hull_corners(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], label: pdf[label].iloc[0], "n": [len(pdf)] + [0] * (len(x) - 1), "x": x, "y": y})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        got = hull_area_of(pdf["x"].to_numpy(), pdf["y"].to_numpy()) if pdf["n"].sum() >= least else 0.0
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], label: [pdf[label].iloc[0]], "area": [got]})

    size = df.groupBy("cloud_id", label).agg(F.ceil(F.count("*") / F.lit(part_rows)).alias("_p"))
    dealt = df.select("cloud_id", label, "x", "y").join(size, ["cloud_id", label]).withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.col("_p"))).drop("_p")
    part = dealt.groupBy("cloud_id", label, "_s").applyInPandas(corners, f"cloud_id string, {label} {kind}, n long, x double, y double")
    return part.groupBy("cloud_id", label).applyInPandas(area, f"cloud_id string, {label} {kind}, area double")


def tree_stats(points: DataFrame, dtm_z: str = "dtm_z", label: str = "itc", least: int = 7, include_unassigned: bool = True, area: bool = True) -> DataFrame:
    """Per tree: mean x, y; top z; height above ground; crown area. ``points`` carries the ground height under each point."""
    rows = points if include_unassigned else points.filter(F.col(label) > 0)
    height: Column = F.max("z") - (F.min("z") + F.min(dtm_z)) * 0.5
    stats = rows.groupBy("cloud_id", label).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("z").alias("z"), height.alias("height"), F.count("*").alias("n"))
    return stats.join(hull_area(rows, label, least), ["cloud_id", label], "left") if area else stats
