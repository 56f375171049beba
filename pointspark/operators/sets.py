"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_patches(*patches: DataFrame) -> DataFrame:
    """All rows of all patches."""
    return reduce(lambda a, b: a.unionByName(b), patches)


def union_reverse_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs and their reversals, each once."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))  # a union would compute the pairs twice
    return pairs.select("cloud_id", both.alias("p")).select("cloud_id", "p.src", "p.dst").distinct()


def not_in_used(nodes: DataFrame, used: DataFrame, ident: str = "node_id") -> DataFrame:
    return nodes.join(used.select("cloud_id", ident), ["cloud_id", ident], "left_anti")
