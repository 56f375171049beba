"""Block-wise model inference with a pluggable predictor.

A predictor gets one block's occupied voxels and returns values per voxel; everything around it (blocks, voxels,
gathering, merging over overlaps) is relational. Trained networks are not part of this package: ``OnnxModel`` runs
one from a file, and the rule predictors are deterministic stand-ins that make the plumbing testable.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.operators.aggregates import overlap_last, seen_mask, voxel_mean_flag
from pointspark.operators.filters import apply_offsets, loc_in_tile
from pointspark.operators.grid import block_voxelize, sliding_blocks, voxels
from pointspark.operators.ranks import dense_ranks
from pointspark.operators.spatial import nn_xy, nn_xyz
from pointspark.schema import XYZ


class Predictor(Protocol):
    """``outputs`` names the columns that a call adds to ``i, j, k, n`` (and any features) of one block."""

    outputs: tuple[str, ...]

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame: ...


class HeightRule:
    """Class 1 at ``height`` metres above the block's floor or more, else 0."""

    outputs = ("label",)

    def __init__(self, height: float, resolution_z: float):
        self.height, self.resolution_z = height, resolution_z

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(label=(block["k"] * self.resolution_z >= self.height).astype(float))


class DensityRule:
    """Confidence = points of the voxel / most points of a voxel of the block; a constant radius."""

    outputs = ("conf", "radius")

    def __init__(self, radius: float = 1.0):
        self.radius = radius

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(conf=block["n"] / block["n"].max(), radius=self.radius)


class ZeroOffset:
    """No offset on any axis."""

    def __init__(self, axes: int = 2):
        self.outputs = ("dx", "dy", "dz")[:axes]

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(**dict.fromkeys(self.outputs, 0.0))


class FeatureOffset:
    """An offset of ``shift`` voxels times a feature of the voxel (``has_loc``, ``mean_flag``), a number for each axis."""

    def __init__(self, feature: str, shift: tuple[float, ...]):
        self.feature, self.shift = feature, shift
        self.outputs = ("dx", "dy", "dz")[: len(shift)]

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(**{o: block[self.feature] * s for o, s in zip(self.outputs, self.shift, strict=True)})


_sessions: dict[int, object] = {}


class OnnxModel:
    """A network in ONNX form: one float input (1, 1, *size) of occupancy and one output (1, channels, *size).

    Read at the occupied voxels: with the one output ``label`` the channel of the largest value, else a channel for
    each of ``outputs``. A worker opens a network once.
    """

    def __init__(self, weights: bytes, size: tuple[int, int, int], outputs: tuple[str, ...] = ("label",)):
        self.weights, self.size, self.outputs = weights, size, tuple(outputs)

    def __call__(self, block: pd.DataFrame) -> pd.DataFrame:
        import onnxruntime

        key = hash(self.weights)
        if key not in _sessions:
            _sessions.clear()
            _sessions[key] = onnxruntime.InferenceSession(self.weights, providers=["CPUExecutionProvider"])
        network = _sessions[key]
        dense = dense_block(block, self.size)[None, None]
        values = network.run(None, {network.get_inputs()[0].name: dense})[0][0][:, block["i"], block["j"], block["k"]]
        if self.outputs == ("label",):
            return block.assign(label=values.argmax(axis=0).astype(float))
        return block.assign(**dict(zip(self.outputs, values.astype(float), strict=True)))


def onnx_factory(spark: SparkSession, weights: bytes, size: tuple[int, int, int], outputs: tuple[str, ...] = ("label",)) -> Callable[[], Predictor]:
    """A factory of ``OnnxModel``; the weights are broadcast once (``load_weights`` bounds them)."""
    sent = spark.sparkContext.broadcast(weights)
    return lambda: OnnxModel(sent.value, size, outputs)


def dense_block(block: pd.DataFrame, size: tuple[int, int, int], value: str | None = None) -> np.ndarray:
    """The block as a dense array, for predictors that need one: occupancy, or a column's values."""
    out = np.zeros(size, np.float32)
    out[block["i"], block["j"], block["k"]] = 1.0 if value is None else block[value]
    return out


def softmax(logits: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def predict_blocks(occupied: DataFrame, factory: Callable[[], Predictor]) -> DataFrame:
    """``occupied`` (cloud_id, block_id, voxel, i, j, k, n, features) with the predictor's outputs, one block a group.

    A block is bounded by its voxel grid, whatever the cloud. The factory runs in the worker.
    """
    outputs = factory().outputs
    kept = ["cloud_id", "block_id", "voxel"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return factory()(pdf)[[*kept, *outputs]].astype(dict.fromkeys(outputs, float))

    schema = "cloud_id string, block_id long, voxel long, " + ", ".join(f"{o} double" for o in outputs)
    return occupied.groupBy("cloud_id", "block_id").applyInPandas(run, schema)


def _blocks(points: DataFrame, resolution, size, overlap: float, axes: int, *fields: str) -> DataFrame:
    sides = tuple(r * n for r, n in zip(resolution, size, strict=True))[:axes]
    return block_voxelize(sliding_blocks(points.select("cloud_id", "pid", *XYZ, *fields), sides, overlap), resolution, size)


def _scatter(voxelized: DataFrame, predicted: DataFrame) -> DataFrame:
    return voxelized.join(predicted, ["cloud_id", "block_id", "voxel"])


def component_filter(points: DataFrame, factory: Callable[[], Predictor], resolution, size, num_classes: int = 2, bottom_only: bool = True) -> DataFrame:
    """``cloud_id, pid, label`` from overlapping blocks.

    Two classes: 2 where any block says above, also for points never voxelised, else 1. More: the last block's
    class, ``num_classes - 1`` for points no block visited.
    """
    cells = _blocks(points, resolution, size, 0.1, 2 if bottom_only else 3)
    found = _scatter(cells, predict_blocks(voxels(cells), factory))
    if num_classes <= 2:
        votes = found.select("cloud_id", "pid", (F.col("label") > 0).alias("above"))
        if bottom_only:
            return seen_mask(points, votes)
        from pointspark.operators.aggregates import overlap_or

        return points.select("cloud_id", "pid").join(overlap_or(votes), ["cloud_id", "pid"], "left").withColumn("label", F.coalesce("label", F.lit(1)))
    return overlap_last(points, found.select("cloud_id", "pid", "block_id", F.col("label").cast("int").alias("label")), num_classes)


def _flat_blocks(points: DataFrame, resolution, size, *fields: str) -> DataFrame:
    from pointspark.operators.grid import grid_blocks

    tiles = grid_blocks(points.select("cloud_id", "pid", *XYZ, *fields), resolution[:2], size[:2])
    tiles = tiles.withColumn("block_id", (F.col("bi") * (1 << 24) + F.col("bj")).cast("long")).drop("bi", "bj")
    return block_voxelize(tiles, resolution, size)


def tree_detect(points: DataFrame, factory: Callable[[], Predictor], resolution, size, cutoff: float = 1.0) -> DataFrame:
    """``cloud_id, pid, x, y, z, conf, radius`` per point."""
    from pointspark.operators.filters import tile_height_cut

    cells = _flat_blocks(tile_height_cut(points, cutoff) if cutoff < 1 else points, resolution, size)
    return _scatter(cells, predict_blocks(voxels(cells), factory)).select("cloud_id", "pid", *XYZ, "conf", "radius")


def stem_detect(points: DataFrame, factory: Callable[[], Predictor], resolution, size) -> DataFrame:
    """``cloud_id, block_id, i, j, value, xmin, ymin``: a 2-D mask, the greatest ``conf`` of each voxel column."""
    cells = _flat_blocks(points, resolution, size)
    low = cells.groupBy("cloud_id", "block_id").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"))
    at = voxels(cells).join(predict_blocks(voxels(cells), factory), ["cloud_id", "block_id", "voxel"])
    return at.groupBy("cloud_id", "block_id", "i", "j").agg(F.max("conf").alias("value")).join(low, ["cloud_id", "block_id"])


def tree_offset(points: DataFrame, locations: DataFrame, factory: Callable[[], Predictor], resolution, size) -> DataFrame:
    """``cloud_id, pid, treeoff``: the nearest location (xy) after the predicted offset, numbered from 1 by ``loc_id``.

    A location's voxel column is the feature ``has_loc``. Points outside of their block's grid get 0.
    """
    cells = _flat_blocks(points, resolution, size)
    low = cells.groupBy("cloud_id", "block_id").agg(*[F.min(c).alias("min_" + c) for c in "xy"])
    inside = loc_in_tile(cells, locations).join(locations.select("cloud_id", "loc_id", "x", "y"), ["cloud_id", "loc_id"]).join(low, ["cloud_id", "block_id"])
    marks = inside.select("cloud_id", "block_id", *[F.floor((F.col(a) - F.col("min_" + a)) / r).alias(o) for a, o, r in zip("xy", "ij", resolution, strict=False)]).distinct().withColumn("has_loc", F.lit(1.0))
    occupied = voxels(cells).join(marks, ["cloud_id", "block_id", "i", "j"], "left").withColumn("has_loc", F.coalesce("has_loc", F.lit(0.0)))
    moved = apply_offsets(_scatter(cells, predict_blocks(occupied, factory)), resolution, ("dx", "dy"))
    numbers = dense_ranks(locations, "cloud_id", "loc_id").select("cloud_id", F.col("loc_id").alias("dst"), (F.col("rank") + 1).alias("treeoff"))
    near = nn_xy(moved.select("cloud_id", "pid", *XYZ), locations).join(numbers, ["cloud_id", "dst"])
    return points.select("cloud_id", "pid").join(near.select("cloud_id", F.col("src").alias("pid"), "treeoff"), ["cloud_id", "pid"], "left").withColumn("treeoff", F.coalesce("treeoff", F.lit(0).cast("long")))


def merge_remainder(points: DataFrame, label: str, resolution: float = 0.2) -> DataFrame:
    """Each point takes the label of its voxel's first point (also where it had another)."""
    from pointspark.operators.grid import voxel_key

    keyed = voxel_key(points, resolution, "min")
    first = keyed.groupBy("cloud_id", "i", "j", "k").agg(F.min_by(label, "pid").alias("_l"))
    return keyed.join(first, ["cloud_id", "i", "j", "k"]).select("cloud_id", "pid", F.col("_l").alias(label))


def crown_offset(points: DataFrame, factory: Callable[[], Predictor], resolution, size, label: str = "stemoff") -> DataFrame:
    """``cloud_id, pid, label``: unlabelled points take the label of the labelled point nearest in 3-D after their offset.

    Afterwards every 0.2 m voxel takes the label of its first point.
    """
    cells = _flat_blocks(points, resolution, size, label)
    flags = voxel_mean_flag(cells, label)
    occupied = voxels(cells).join(flags, ["cloud_id", "block_id", "voxel"])
    moved = apply_offsets(_scatter(cells, predict_blocks(occupied, factory)), resolution, ("dx", "dy", "dz"))
    free = moved.filter(F.col(label) <= 0)
    own = points.filter(F.col(label) > 0)
    near = nn_xyz(free.select("cloud_id", "pid", *XYZ), own).join(own.select("cloud_id", F.col("pid").alias("dst"), F.col(label).alias("_l")), ["cloud_id", "dst"])
    named = points.join(near.select("cloud_id", F.col("src").alias("pid"), "_l"), ["cloud_id", "pid"], "left")
    named = named.select("cloud_id", "pid", *XYZ, F.when(F.col(label) > 0, F.col(label)).otherwise(F.coalesce("_l", F.lit(0))).alias(label))
    return merge_remainder(named, label)
