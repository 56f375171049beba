"""Schemas and preconditions of the point-cloud operators.

A cloud is rows ``(cloud_id, pid, x, y, z, fields...)``; identity is the column ``pid``, never row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

XYZ = ("x", "y", "z")


def _schema(**fields) -> StructType:
    return StructType([StructField(k, v()) for k, v in fields.items()])


POINTS = _schema(cloud_id=StringType, pid=LongType, x=DoubleType, y=DoubleType, z=DoubleType)
EDGES = _schema(cloud_id=StringType, src=LongType, dst=LongType, w=DoubleType)
LABELS = _schema(cloud_id=StringType, pid=LongType, label=LongType)
RASTER = _schema(cloud_id=StringType, i=LongType, j=LongType, value=DoubleType)


def require_columns(df: DataFrame, *names: str, producer: str | None = None) -> DataFrame:
    """``df`` itself; raises ``ValueError`` if it lacks a column, naming the operator that makes it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}" + (f"; run {producer} first" if producer else ""))
    return df
