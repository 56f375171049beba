"""Tree segmentation chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.operators.aggregates import mode_positive, multi_base_components
from pointspark.operators.filters import filter_stem, preserve_existing, scatter_back
from pointspark.operators.graph import decimated_components, nearest_source_label, node_graph
from pointspark.operators.grid import decimate
from pointspark.operators.spatial import base_to_component, label_lookup
from pointspark.operators.superpoints import mixture_split
from pointspark.shared import materialize


def stem_clusters(points: DataFrame, bases: DataFrame, resolution: float = 0.06, max_distance: float = 0.3, k: int = 10, split: bool = True) -> DataFrame:
    """``cloud_id, pid, stemoff``: stem of every stem point, from 1; 0 for other and for unreachable points.

    Stem points are decimated and joined to components; components with several bases are split; the components
    make a graph of closest distances, and each takes the label of the base component nearest along it.
    """
    stems = filter_stem(points).select("cloud_id", "pid", "x", "y", "z")
    named, _, inverse = decimated_components(stems, resolution, k)
    named = materialize(named, "stem-components")
    based = materialize(bases.join(base_to_component(bases, named), ["cloud_id", "loc_id"]), "bases")
    if split and not multi_base_components(based).isEmpty():
        parts = mixture_split(named, based)
        # a split component's parts get numbers of their own: the part's least point
        low = parts.groupBy("cloud_id", "label", "part").agg(F.min("pid").alias("_low"))
        parts = parts.join(low, ["cloud_id", "label", "part"]).select("cloud_id", "pid", "_low")
        named = materialize(named.join(parts, ["cloud_id", "pid"], "left").withColumn("label", F.coalesce("_low", "label")).drop("_low"), "split")
        based = materialize(bases.join(base_to_component(bases, named), ["cloud_id", "loc_id"]), "bases")
    edges = materialize(node_graph(named, k, max_distance), "stem-graph")
    nodes = named.select("cloud_id", F.col("label").alias("node")).distinct()
    sources = based.select("cloud_id", F.col("label").alias("node"), F.col("label").alias("target")).distinct()
    found = nearest_source_label(nodes, edges, sources).select("cloud_id", F.col("node").alias("label"), F.col("label").alias("stem"))
    reps = named.join(found, ["cloud_id", "label"]).select("cloud_id", "pid", (F.col("stem") + 1).alias("label"))
    stemoff = label_lookup(inverse, reps, 0).withColumnRenamed("label", "stemoff")
    return scatter_back(points.select("cloud_id", "pid"), stemoff, "stemoff", 0)


def treelabel_chain(members: DataFrame, label: str = "treeoff") -> DataFrame:
    """``cloud_id, pid, pred``: the positive label most frequent in a point's cluster (``members``: pid, cluster, label)."""
    modes = mode_positive(members, label, ("cloud_id", "cluster"))
    return members.join(modes, ["cloud_id", "cluster"]).select("cloud_id", "pid", F.col("mode").alias("pred"))


def crown_clusters(points: DataFrame, resolution: float = 0.06, max_distance: float = 0.3, k: int = 20) -> DataFrame:
    """``cloud_id, pid, itc`` from superpoints (``init_segs``) and tree labels (``treeoff``, 0 = none).

    Each superpoint takes its most frequent positive label; unlabelled ones the label of the labelled one nearest
    along the graph of superpoints, 0 if none is reachable; points that had a label keep it.
    """
    reps, inverse = decimate(points, resolution)
    reps = materialize(reps.select("cloud_id", "pid", "x", "y", "z", F.col("init_segs").alias("label"), "treeoff"), "reps")
    blobs = mode_positive(reps.withColumnRenamed("label", "blob"), "treeoff", ("cloud_id", "blob"))
    edges = materialize(node_graph(reps, k, max_distance, crowns=True), "crown-graph")
    nodes = blobs.select("cloud_id", F.col("blob").alias("node"))
    sources = blobs.filter("mode > 0").select("cloud_id", F.col("blob").alias("node"), F.col("blob").alias("target"))
    clusters = nearest_source_label(nodes, edges, sources).select("cloud_id", F.col("node").alias("label"), F.col("label").alias("cluster"))
    # the cluster's label is that most frequent among its blobs; blobs reached from nowhere form one cluster of mode 0
    named = clusters.join(blobs.withColumnsRenamed({"blob": "label"}), ["cloud_id", "label"])
    tree = mode_positive(named, "mode", ("cloud_id", "cluster")).withColumnRenamed("mode", "tree")
    per_rep = reps.join(clusters, ["cloud_id", "label"]).join(tree, ["cloud_id", "cluster"]).select("cloud_id", "pid", F.col("tree").alias("label"))
    pred = label_lookup(inverse, per_rep, 0).withColumnRenamed("label", "pred")
    return preserve_existing(points.select("cloud_id", "pid", "treeoff").join(pred, ["cloud_id", "pid"])).select("cloud_id", "pid", F.col("pred").alias("itc"))


def tree_inventory(points: DataFrame, resolution: float = 2.0, label: str = "itc", fill: str = "none", area: bool = False, include_unassigned: bool = True) -> DataFrame:
    """Per-tree statistics: ground raster, ground height of the nearest cell under each vegetation point, one group per tree.

    With ``fill='none'`` empty ground cells are absent (the nearest occupied one serves).
    """
    from pointspark.operators.aggregates import tree_stats
    from pointspark.operators.raster import dtm_stats
    from pointspark.operators.spatial import nn_xy

    cells = materialize(dtm_stats(points, resolution, fill, frame=points).withColumn("cell", F.col("row") * F.lit(1 << 31) + F.col("col")), "ground")
    vegetation = points.filter("treefilter > 1")
    near = nn_xy(vegetation, cells, right_id="cell")
    ground = near.join(cells.select("cloud_id", F.col("cell").alias("dst"), F.col("z").alias("dtm_z")), ["cloud_id", "dst"]).select("cloud_id", F.col("src").alias("pid"), "dtm_z")
    return tree_stats(vegetation.join(ground, ["cloud_id", "pid"]), label=label, area=area, include_unassigned=include_unassigned)
