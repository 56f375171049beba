"""Materialised intermediates in the folder that every executor shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process and not yet deleted, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pointspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pointspark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage; unlike executor-local storage the files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def discard(*frames: DataFrame | None) -> None:
    """Delete frames from ``materialize`` that nothing will read again; others are passed over."""
    for df in frames:
        if df is not None and getattr(df, "_written", None):
            _delete(df.sparkSession, df._written)
            df._written = None


def mark() -> int:
    """A point in time for ``clear``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was written since ``mark`` gave ``since``, but for frames to keep: call it when a query's result is used up."""
    kept = {getattr(df, "_written", None) for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _delete(spark, path)
