"""Tile-local operators over a stream of arriving points, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def foreach_cloud(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and append its rows, partitioned by batch.

    A batch that is run again replaces its own partition, so the sink is exactly-once. Clouds must not be
    split over batches unless the operator is local to a point.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_cell_min(stream: DataFrame, resolution: float) -> DataFrame:
    """Lowest z per absolute xy cell of a stream of points (output mode ``complete`` or ``update``)."""
    from pyspark.sql import functions as F

    keys = [F.floor(F.col(c) / resolution).alias(k) for c, k in (("x", "col"), ("y", "row"))]
    return stream.groupBy("cloud_id", *keys).agg(F.min("z").alias("value"))
