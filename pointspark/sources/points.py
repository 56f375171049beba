"""Clouds: reading, the clouds derived from the relational test tables, and field updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.schema import require_columns

#: A cloud of the orders (the tables hold no LiDAR); both Spark SQL and DuckDB run it.
POINTS_SQL = """
  SELECT 'c0' AS cloud_id, o_orderkey AS pid,
    (CAST(round(o_totalprice*100) AS BIGINT) % 10000)/CAST(100 AS DOUBLE) AS x,
    ((o_custkey*37+o_orderkey*11) % 10000)/CAST(100 AS DOUBLE) AS y,
    ((o_orderkey*13) % 3000)/CAST(100 AS DOUBLE) AS z,
    CASE WHEN o_orderstatus='F' THEN 1 ELSE 2 END AS treefilter,
    CASE WHEN o_orderpriority='1-URGENT' THEN 2 ELSE 1 END AS stemcls,
    CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 2 ELSE 1 END AS branchcls,
    CAST(o_custkey % 40 AS BIGINT) AS itc,
    CASE WHEN o_orderpriority='1-URGENT' THEN CAST(o_custkey % 40 AS BIGINT)+1 ELSE CAST(0 AS BIGINT) END AS stemoff,
    (o_custkey % 100)/CAST(100 AS DOUBLE) AS conf,
    (20 + o_custkey % 50)/CAST(100 AS DOUBLE) AS radius
  FROM orders"""

TREELOC_SQL = """
  SELECT 'c0' AS cloud_id, c_custkey AS loc_id,
    ((c_custkey*7919) % 10000)/CAST(100 AS DOUBLE) AS x,
    ((c_custkey*6007) % 10000)/CAST(100 AS DOUBLE) AS y,
    ((c_custkey*31) % 3000)/CAST(100 AS DOUBLE) AS z,
    (1 + c_custkey % 5)*CAST(0.5 AS DOUBLE) AS radius
  FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0"""


def derived(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "orders", POINTS_SQL)


def tree_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "customer", TREELOC_SQL)


def scan_points(spark: SparkSession, path: str) -> DataFrame:
    """A cloud stored as Parquet."""
    return require_columns(spark.read.parquet(path), "cloud_id", "pid", "x", "y", "z")


def scan_field(cloud: DataFrame, name: str, optional: bool = False) -> DataFrame | None:
    """``cloud_id, pid`` and one field; None if an optional field is missing, else ``ValueError``."""
    if optional and name not in cloud.columns:
        return None
    return require_columns(cloud, name).select("cloud_id", "pid", name)


def upsert_field(cloud: DataFrame, values: DataFrame, name: str, default=0) -> DataFrame:
    """``cloud`` with field ``name`` replaced whole by ``values`` (cloud_id, pid, name); ``default`` elsewhere."""
    new = values.select("cloud_id", "pid", F.col(name).alias("_new"))
    old = [c for c in cloud.columns if c != name]
    return cloud.join(new, ["cloud_id", "pid"], "left").select(*old, F.coalesce("_new", F.lit(default)).alias(name))


def field_range(cloud: DataFrame, name: str) -> DataFrame:
    return cloud.groupBy("cloud_id").agg(F.min(name).alias("min_value"), F.max(name).alias("max_value"))


def child_cloud(cloud: DataFrame, children: DataFrame) -> DataFrame:
    """The child cloud's rows of the clouds in ``cloud``; raises ``ValueError`` if there are none."""
    found = children.join(cloud.select("cloud_id").distinct(), "cloud_id", "left_semi")
    if found.limit(1).count() == 0:
        raise ValueError("no child cloud; run tree location first")
    return found


def emit_cloud(cloud: DataFrame, path: str, suffix: str) -> str:
    """Write a derived cloud, ``<name>_<suffix>`` for each name, partitioned by cloud."""
    named = cloud.withColumn("cloud_id", F.concat("cloud_id", F.lit(f"_{suffix}")))
    named.write.mode("overwrite").partitionBy("cloud_id").parquet(path)
    return path
