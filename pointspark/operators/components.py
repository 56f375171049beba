"""Connected components: forests inside of partitions first, then alternating large-star and small-star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.shared import discard, materialize


#: Rows that one task aggregates at most, more or less; so many edges times four are joined at once.
DEALT = 250_000


def _least(edges: DataFrame) -> DataFrame:
    """``u, m, x``: the smallest and the largest ``v`` of each ``u``, in tasks of about ``DEALT`` rows however well these compress."""
    rows = edges.count()
    dealt = edges.repartition(-(-rows // DEALT), "u") if rows > 4 * DEALT else edges
    return dealt.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the smallest of its component, and that smallest one: as many edges as join what these edges join."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (up[a] != up[b]).any():
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while (up != up[up]).any():
            up = up[up]
    inner = np.flatnonzero(up != np.arange(len(ids)))
    return ids[inner], ids[up[inner]]


def _forests(batches: Iterator[pa.RecordBatch], at_once: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> pa.RecordBatch:
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= at_once:
            yield joined()
    if held:
        yield joined()


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """``id, component`` of all nodes of at most ``rows`` edges, which one task gets whole."""
    for stars in _forests(batches, rows + 1):
        tops = pc.unique(stars.column(1))
        yield pa.RecordBatch.from_pydict({"id": pa.concat_arrays([stars.column(0), tops]), "component": pa.concat_arrays([stars.column(1), tops])})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every node of an undirected edge list; component = smallest id reachable.

    Loops and null ends are ignored; nodes without any edge to another node are not returned. Each task replaces
    its edges by a spanning forest of stars, in slices of bounded size. Forests of no more edges than such a slice are joined by one
    more task, without any shuffle; else each round after that is aggregations on the node id and joins with what still moves:
    centres that are linked to a smaller node, and nodes of more than one centre. The state, rows ``u > v``, is written to the
    shared folder every round.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialize(e.mapInArrow(_forests, "u long, v long"), "cc")
    rows = e.count()
    if rows <= 4 * DEALT:
        found = materialize(e.coalesce(1).mapInArrow(lambda batches: _joined(batches, rows), "id long, component long"), "cc-joined")
        discard(e)
        return found
    while True:
        low = materialize(_least(e), "cc-low")
        # large star: what hangs on a centre goes over to the smallest node that the centre is linked to
        moved = materialize(e.select("v").distinct().join(low.select(F.col("u").alias("v"), "m"), "v"), "cc-moved")
        if moved.isEmpty() and low.filter("m < x").isEmpty():
            break
        large = materialize(e.join(moved, "v", "left").select("u", F.coalesce("m", "v").alias("v")), "cc-large")
        # small star: the centres of a node hang on the smallest of them
        least = materialize(_least(large), "cc-least")
        forked = large.join(least.filter("m < x").select("u", "m"), "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(forked.distinct().unionByName(least.select("u", F.col("m").alias("v"))), "cc")
        discard(last, low, moved, large, least)
    ends = low.select(F.col("u").alias("id"), F.col("m").alias("component"))
    return ends.unionByName(low.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
