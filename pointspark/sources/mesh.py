"""Meshes and branch trees as files; a cloud's skeleton is one row per path node, small beside its points."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointspark.operators.qsm import drop_nan_vertices, tube_mesh, tube_samples


def obj_lines(nodes: DataFrame, interval: float = 0.05, sides: int = 16) -> DataFrame:
    """``cloud_id, kind, ord, line`` of an OBJ file: all vertices, then all quads, numbered from 1 over the paths."""
    vertices, faces = drop_nan_vertices(*tube_mesh(tube_samples(nodes, interval), sides))
    before = Window.partitionBy("cloud_id").orderBy("path_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = vertices.groupBy("cloud_id", "path_id").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select("cloud_id", "path_id", "_o")
    v = vertices.join(offsets, ["cloud_id", "path_id"]).select("cloud_id", F.lit(0).alias("kind"), (F.col("_o") + F.col("vid")).alias("ord"), F.lit(0).alias("sub"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    num = [F.col("_o") + F.col(c) + 1 for c in ("v1", "v2", "v3", "v4")]
    f = faces.join(offsets, ["cloud_id", "path_id"]).select("cloud_id", F.lit(1).alias("kind"), num[0].alias("ord"), F.col("v2").alias("sub"), F.concat_ws(" ", F.lit("f"), *[n.cast("string") for n in num]).alias("line"))
    return v.unionByName(f)


def write_obj(nodes: DataFrame, path: str, interval: float = 0.05, sides: int = 16) -> None:
    """An ordered text file per cloud, ``cloud_id=<id>/`` under ``path``."""
    lines = obj_lines(nodes, interval, sides)
    one = lines.repartition("cloud_id").sortWithinPartitions("cloud_id", "kind", "ord", "sub")
    one.select("cloud_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("cloud_id").text(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (in no order) and quads of OBJ files."""
    part = F.split("value", " ")
    rows = spark.read.text(path).withColumn("p", part)
    v = rows.filter("startswith(value, 'v ')").select(*[F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    f = rows.filter("startswith(value, 'f ')").select(*[F.col("p")[i].cast("long").alias(f"v{i}") for i in range(1, 5)])
    return v, f


def tree_xml(rows: list) -> str:
    """Nested branches of one cloud from its path nodes: a branch stands inside the node that it starts from."""
    paths: dict[int, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["path_id"], r["seq"])):
        paths[r["path_id"]].append(r)
    starts: dict[int, list[int]] = defaultdict(list)
    for p, nodes in paths.items():
        if p:
            starts[nodes[0]["node_id"]].append(p)
    root, count, done = ET.Element("tree"), 0, set()

    def branch(at: ET.Element, p: int, parent: int, level: int) -> None:
        nonlocal count
        count += 1
        done.add(p)
        element, before = ET.SubElement(at, "branch", id=str(count), parent_node=str(parent), level=str(level)), -1
        for r in paths[p]:
            node = ET.SubElement(element, "node", id=str(r["node_id"]), prev_node=str(before), level=str(level), **{c: f"{r[c]:.6f}" for c in ("x", "y", "z", "radius")})
            if r["node_id"] != parent:
                for q in starts[r["node_id"]]:
                    if q not in done:
                        branch(node, q, r["node_id"], level + 1)
            before = r["node_id"]

    branch(root, 0, -1, 1)
    for p in sorted(paths):
        if p not in done:  # its start lies on no other path
            branch(root, p, paths[p][0]["node_id"], 2)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def write_xml(nodes: DataFrame, path: str) -> None:
    """A document per cloud, written by the tasks: one row of text each."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cloud_id": [pdf["cloud_id"].iloc[0]], "value": [tree_xml(pdf.to_dict("records"))]})

    rows = nodes.select("cloud_id", "path_id", "seq", "node_id", "x", "y", "z", "radius")
    rows.groupBy("cloud_id").applyInPandas(run, "cloud_id string, value string").write.mode("overwrite").partitionBy("cloud_id").text(path)
