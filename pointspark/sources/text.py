"""White-space separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_xyz_text(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z"), distinct: bool = True) -> DataFrame:
    """Numbers per line, any white space between; repeated rows once."""
    part = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).filter("trim(value) <> ''").select(*[F.get(part, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return rows.dropDuplicates() if distinct else rows


def write_text(df: DataFrame, path: str, digits: int = 6, header: bool = False) -> None:
    """Columns with a fixed number of decimals, blank separated."""
    kinds = dict(df.dtypes)
    cols = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").csv(path, sep=" ", header=header, quote="")


def treestat_lines(stats: DataFrame, label: str = "itc") -> DataFrame:
    """Tree statistics as they are written: identifier and five numbers of three decimals."""
    five = ["x", "y", "z", "height", "crown_area"]
    return stats.select(F.col(label).cast("long").alias("itc_id"), *[F.format_string("%.3f", F.col(c)).alias(c) for c in five])


def write_treestat(stats: DataFrame, path: str, label: str = "itc") -> None:
    treestat_lines(stats, label).orderBy("itc_id").coalesce(1).write.mode("overwrite").csv(path, sep=" ", header=True)  # a row per tree
