"""Places and dense ranks of rows in a global order, without a window over all rows of a cloud.

Rows are range-partitioned by sampled bounds and sorted inside of partitions; a row's place is its place inside of the
partition plus the rows of the partitions before, so the only thing that one task sees whole is a row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointspark.shared import materialize

#: monotonically_increasing_id keeps the place inside of a partition in its lower bits.
_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, *order: str | Column, name: str = "at") -> DataFrame:
    """``rows`` with ``name``: their place from 0 in ``order``. Rows alike in all of ``order`` are placed as they come."""
    order = tuple(F.col(c) if isinstance(c, str) else c for c in order)
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), inner.alias("_i"))
    placed = materialize(placed, "placed")  # numbers of partitions hold in what is written
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over a row per partition
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    return placed.join(sizes, "_p").select(*rows.columns, (F.col("_i") + F.col("_b")).alias(name))


def dense_ranks(rows: DataFrame, within: str, value: str, name: str = "rank") -> DataFrame:
    """``within, value, name``: the distinct values' ranks from 0 inside of each ``within``; nulls are left out."""
    keys = rows.select(within, value).filter(F.col(value).isNotNull()).distinct()
    placed = materialize(numbered(keys, within, value, name="_at"), "ranks")
    first = placed.groupBy(F.col(within).alias("_w")).agg(F.min("_at").alias("_first"))
    return placed.join(first, F.col(within).eqNullSafe(F.col("_w"))).select(within, value, (F.col("_at") - F.col("_first")).alias(name))
