"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates and queries are dealt in blocks of bounded size, and each pair of blocks is one group of one shuffle,
so a task holds one block of either and nothing is broadcast. A block of candidates sorts its rows once per dimension; for a query every
list is read from the end that the query component's sign asks for. Rows met are scored whole (random access);
the threshold is the inner product of the query with the values at the current depth of all lists, which no
unseen row can beat. Reading stops when the threshold is below the kth score found (equal scores may still hold
a smaller identifier). A block's k best per query are then merged per query, so the result is exact.

Rows travel as slices of quantized vectors, two bytes a component where that holds them. The slices are written
before they are dealt, by their number and not by an identifier, so no identifier is a hot group and a task that is
run again finds the same rows.

Defined cases: vectors that are null or hold null or non-finite components take no part; a query meets only
candidates of its own length; rows with the query's identifier count as its own and are left out; repeated
rows of another identifier are candidates each; ties go to the smaller identifier; rows with a null identifier
take no part; where one identifier holds several different vectors each of them is a query, and their scores are
ranked together, so a candidate may be listed once for each; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.llm.common import small_batches
from pointspark.shared import materialize


class SortedLists:
    """One block's rows, sorted by every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.whole = self.x.astype(np.int64)
        self.up = np.argsort(self.x, axis=0, kind="stable")  # ascending, a column per dimension

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the k best rows for ``q``, best first."""
        n, dims = self.x.shape
        used = np.flatnonzero(q)
        positive = q[used] > 0
        exact = np.abs(q).sum() * np.abs(self.x).max(initial=0) < 2**53
        data, query = (self.x, q) if exact else (self.whole, q.astype(np.int64))
        seen = np.zeros(n, bool)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.float64 if exact else np.int64)
        depth, step = 0, 64
        while depth < n:
            end = min(n, depth + step)
            place = np.arange(depth, end)
            met = np.where(positive, self.up[n - 1 - place][:, used], self.up[place][:, used])
            mask = np.zeros(n, bool)
            mask[met.ravel()] = True
            if not len(used):
                mask[:] = True
                end = n
            new = np.flatnonzero(mask & ~seen)
            seen |= mask
            ids = np.concatenate((ids, self.ids[new]))
            scores = np.concatenate((scores, data[new] @ query))
            other = ids != own
            ids, scores = ids[other], scores[other]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            depth, step = end, step * 2
            if len(ids) == k and depth < n:
                edge = np.where(positive, self.up[n - depth, used], self.up[depth - 1, used])
                if data[edge, used] @ query[used] < scores[-1]:
                    break
        return ids, scores.astype(np.int64)


def quantize(batch: pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows ``(identifier, vector)`` of a batch that take part, by vector length: identifiers and floor(scale * x)."""
    by: dict[int, list] = {}
    for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not x.is_valid or x.values.null_count:
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(v).all():
            by.setdefault(len(v), ([], []))
            by[len(v)][0].append(i)
            by[len(v)][1].append(np.floor(scale * v))
    return {n: (np.array(ids, np.int64), np.array(x).reshape(len(ids), n)) for n, (ids, x) in by.items()}


def _slices(rows: DataFrame, scale: int, slice_rows: int) -> DataFrame:
    """``d, n, wide, ids, xs, at``: up to ``slice_rows`` quantized rows of one length in a record, two bytes a value if they fit.

    Written, so that a slice holds the same rows whenever it is read; ``at`` numbers the slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (ids, x) in quantize(batch, scale).items():
                starts = range(0, len(ids), slice_rows)
                small = [bool((np.abs(x[a : a + slice_rows]) < 2**15).all()) for a in starts]
                xs = [x[a : a + slice_rows].astype(np.int16 if s else np.float64).tobytes() for a, s in zip(starts, small, strict=True)]
                sizes = [len(ids[a : a + slice_rows]) for a in starts]
                yield pa.RecordBatch.from_pydict({"d": pa.array([n] * len(xs), pa.int32()), "n": pa.array(sizes, pa.int64()), "wide": pa.array([not s for s in small]), "ids": pa.array([ids[a : a + slice_rows].tobytes() for a in starts], pa.binary()), "xs": pa.array(xs, pa.binary())})

    packed = rows.mapInArrow(run, "d int, n long, wide boolean, ids binary, xs binary")
    return materialize(packed.withColumn("at", F.monotonically_increasing_id()), "slices")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 8_192, query_rows: int = 16_384, slice_rows: int = 512, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose identifier is divisible by ``every``."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    asked = rows.filter((F.pmod("vec_id", F.lit(every)) == 0) & F.col("x").isNotNull()).dropDuplicates(["vec_id", "x"])
    cands, asks = _slices(rows, scale, slice_rows), _slices(asked, scale, slice_rows)
    n_cands, n_asks = (x.agg(F.sum("n")).first()[0] or 0 for x in (cands, asks))
    # at least a few blocks of candidates for each core; a block has at most about ``block_rows`` rows
    blocks = min(max(1, -(-n_cands // slice_rows)), max(-(-n_cands // block_rows), 2 * spark.sparkContext.defaultParallelism))
    parts = max(1, -(-n_asks // query_rows))
    mine, other = F.pmod(F.xxhash64("at"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = cands.select("d", "wide", "ids", "xs", F.lit(False).alias("asks"), mine.alias("block"), every_of(parts).alias("part"))
    sides = sides.unionByName(asks.select("d", "wide", "ids", "xs", F.lit(True).alias("asks"), every_of(blocks).alias("block"), other.alias("part")))

    def side(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        d = group.column("d")[0].as_py()
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64)
        xs = [np.frombuffer(x, np.float64 if w else np.int16).astype(np.float64) for x, w in zip(group.column("xs").to_pylist(), group.column("wide").to_pylist(), strict=True)]
        return ids, np.concatenate(xs).reshape(len(ids), d)

    def search(group: pa.Table) -> pa.Table:
        is_ask = group.column("asks").to_numpy(zero_copy_only=False)
        found = [(np.empty(0, np.int64),) * 3]
        if is_ask.any() and not is_ask.all():
            own, q = side(group.filter(pa.array(is_ask)))
            ids, x = side(group.filter(pa.array(~is_ask)))
            for at in range(0, len(ids), 2 * block_rows):
                lists = SortedLists(ids[at : at + 2 * block_rows], x[at : at + 2 * block_rows])
                for o, v in zip(own, q, strict=True):
                    best, scores = lists.top(o, v, k)
                    found.append((np.full(len(best), o), best, scores))
        asked, best, scores = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(asked, pa.int64()), "vec_id": pa.array(best, pa.int64()), "score": pa.array(scores, pa.int64())})

    # a stated number of partitions: the work of a group is much larger than its bytes
    dealt = sides.repartition(min(blocks * parts, 100_000), "d", "block", "part")
    found = dealt.groupBy("d", "block", "part").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
