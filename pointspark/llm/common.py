"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word definition; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


#: Column in which an operator carries a caller's whole row, whose columns may have any names.
ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker; the default would hold 64 MB of it three times over.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python workers by ``BATCH_BYTES``, unless the session asks for less."""
    if int(spark.conf.get(_BATCH).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def release() -> None:
    """Give memory that a task has freed back to the system: a worker lives on and is not alone in its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def row_keys(*cols: str) -> list[Column]:
    """Two 64-bit hashes of a row's identifying columns: rows alike in these columns share them."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]
    return [F.xxhash64(F.lit(7), *parts).alias("_k1"), F.xxhash64(F.lit(1_000_003), *parts).alias("_k2")]


def nested(docs: DataFrame) -> Column:
    """A row of ``docs`` as one struct named ``ROW``."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)


def field(name: str) -> Column:
    return F.col(ROW).getField(name)


def unnested(docs: DataFrame, *without: str) -> list[Column]:
    """The columns of ``docs``, taken from ``ROW``, but for those that an operator replaces."""
    return [field(c).alias(c) for c in docs.columns if c not in without]


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def sums_before(rows: DataFrame, keys: list[str], at: str, value: str, width: int) -> DataFrame:
    """``rows`` (one of each ``keys`` and integer ``at``) with ``_before``: the sum of ``value`` over smaller ``at``.

    In two levels, sums of ``width`` neighbours first, so no task holds more than about ``width`` rows of a key or
    one row for each ``width``.
    """
    marked = rows.withColumn("_g", F.floor(F.col(at) / F.lit(width)).cast("long"))
    above = marked.groupBy(*keys, "_g").agg(F.sum(value).alias("_gs"))
    earlier = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(keys)], F.col("_g").alias("_gk"), F.coalesce(F.sum("_gs").over(earlier), F.lit(0)).alias("_gb"))
    within = Window.partitionBy(*keys, "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = marked.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = F.col("_g") == F.col("_gk")
    for i, c in enumerate(keys):
        on &= same(c, f"_of{i}")
    return inner.join(above, on).select(*rows.columns, (F.col("_gb") + F.col("_in")).alias("_before"))


#: A key with more than one in HEAVY of all rows is heavy, so there are fewer than HEAVY such keys.
HEAVY = 1024


def join_heavy(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], count: str, total: int) -> DataFrame:
    """Inner equi-join of ``left`` with ``right``, which has one row for each key and how often ``left`` holds it in ``count``.

    The rows of heavy keys meet a broadcast of fewer than ``HEAVY`` rows where they are; only the others are shuffled.
    Give frames that are written, as both are read twice. Rows of ``right`` must be of bounded size.
    """
    heavy = right.filter(F.col(count) * HEAVY > total)
    others = right.filter(F.col(count) * HEAVY <= total)
    match = lambda: [F.col(a) == F.col(b) for a, b in on]
    met = left.join(F.broadcast(heavy), match())
    rest = left.join(F.broadcast(heavy.select(*[b for _, b in on])), match(), "left_anti")
    return met.unionByName(rest.join(others, match()))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes.split() cuts at exactly the ASCII white space of SPACE."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words one hash of them all."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(w) < k:
        return np.array([digest(b" ".join(w), seed=len(w))], np.uint64)
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    n = len(w) - k + 1
    acc = mix(h[:n], 1)
    with np.errstate(over="ignore"):
        for i in range(1, k):
            acc = mix(acc + h[i : i + n], i + 1)
    return np.unique(acc)
