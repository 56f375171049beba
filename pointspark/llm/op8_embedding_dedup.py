"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells, one row kept per group.

Equal vectors are one class from the start. Centroids are fitted on a bounded sample. A class is at home in
the cell of its nearest centroid and visits other cells that could hold a vector within the threshold angle. A
neighbour at home in cell c is nearer to c than to the row's own centroid c_x, so x . (c_x - c) is at most
|c_x - c| sin(angle); cells farther than their radius allows are not visited either. Both bounds are exact, so no
link is lost whatever the vectors. A finite ``spread`` takes min(1, spread / sqrt(dimensions)) of the first
bound, which visits fewer cells and loses links of vectors that do not fill all dimensions.

Cells are gathered to blocks of about ``bin_rows`` rows, and larger cells are cut to several. Each pair of blocks
is one product of the rows of either block that visit the other, ``block_rows`` rows at a time, so every pair of
rows is compared once and no cell is one task. Rows travel as slices, many in one record, in single precision if
that loses nothing. A product gives counts of links and a spanning forest, never the pairs themselves.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing;
vectors of different lengths link with nothing; rows with a null identifier take no part and get a null
component; repeated rows count as other vectors, and so do different vectors under one identifier: each of these rows
has its own links and its own component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.llm.common import small_batches
from pointspark.operators.components import connected_components
from pointspark.shared import discard, materialize


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chunks(n: int, width: int, values: int = 1 << 22) -> Iterator[slice]:
    """Slices of ``n`` rows that make matrices of about ``values`` with ``width`` columns."""
    step = max(64, values // max(1, width))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """``k`` unit centroids at most for the unit rows ``x``."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[s] @ c.T).argmax(axis=1) for s in chunks(len(x), len(c))])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], c)
    return c


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def forest(h_ids: np.ndarray, u_ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest identifier reachable inside the block, for each row of either side."""
    big = np.iinfo(np.int64).max
    hl, ul = h_ids.copy(), u_ids.copy()
    while True:
        h2 = np.minimum(hl, np.where(near, ul[None, :], big).min(axis=1, initial=big))
        u2 = np.minimum(ul, np.where(near, h2[:, None], big).min(axis=0, initial=big))
        if (h2 == hl).all() and (u2 == ul).all():
            return hl, ul
        hl, ul = h2, u2


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 1500, max_cells: int = 8192, sample_rows: int = 20_000, block_rows: int = 1024, bin_rows: int = 8192, spread: float = math.inf, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    spark = vectors.sparkSession
    small_batches(spark)
    angle = math.acos(threshold)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    fit = F.col("vec_id").isNotNull() & F.expr("coalesce(forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0), false)")
    plain = F.transform("x", lambda v: v + F.lit(0.0))  # -0.0 as 0.0
    keyed = rows.select("vec_id", F.when(fit, plain).alias("x"))
    keyed = keyed.withColumn("_h1", F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x"))).withColumn("_h2", F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(2), "x")))
    classes = keyed.filter("x is not null").groupBy("_h1", "_h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("x").alias("x"))
    # a class goes by a number, unique in what is written: its smallest identifier may be that of another class, too
    classes = materialize(classes.withColumn("no", F.monotonically_increasing_id()), "classes")

    lengths = {r["d"]: r["n"] for r in classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    total, top = max(1, sum(lengths.values())), float(1 << 63)
    wanted = max(sample_rows, 8 * min(max_cells, total // cell_rows))  # a few rows for each centroid
    chosen = F.shiftrightunsigned(F.xxhash64(F.lit(3), "_h1", "_h2"), 1).cast("double") <= F.lit(min(top, top * wanted / total))
    sample = classes.filter(chosen).select(F.size("x").alias("d"), "_h1", "x").toArrow()  # about ``wanted`` rows
    centroids = {}
    if sample.num_rows:
        ds = sample.column("d").to_numpy()
        ordered = sample.take(pa.array(np.lexsort((sample.column("_h1").to_numpy(), ds))))
        ds = ordered.column("d").to_numpy()
        for d in np.unique(ds):
            x = unit(matrix(ordered.filter(pa.array(ds == d)).column("x")))
            centroids[int(d)] = spherical_kmeans(x, max(1, min(max_cells, -(-lengths[int(d)] // cell_rows), len(x))))
    for d in lengths:
        centroids.setdefault(d, np.eye(1, d))
    table = spark.sparkContext.broadcast(centroids)  # at most max_cells unit vectors per length

    def per_length(batch: pa.RecordBatch):
        d = np.array([len(v) for v in batch.column("x")], np.int64)
        for n in np.unique(d):
            own = batch.filter(pa.array(d == n))
            yield int(n), own, unit(matrix(own.column("x")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, own, u in per_length(batch):
                c = table.value[n]
                best = [((sims := u[s] @ c.T).argmax(axis=1), sims.max(axis=1)) for s in chunks(len(u), len(c))]
                home, sim = (np.concatenate(v) for v in zip(*best, strict=True))
                given = {"d": pa.array(np.full(len(u), n, np.int32)), "cell": pa.array(home.astype(np.int32)), "sim": pa.array(sim)}
                yield pa.RecordBatch.from_pydict(given | {c: own.column(c) for c in ("no", "mult", "x")})

    homes = classes.select("no", "mult", "x").mapInArrow(assign, "d int, cell int, sim double, no long, mult long, x array<double>")
    homes = materialize(homes, "homes")
    cells = homes.groupBy("d", "cell").agg(F.count("*").alias("n"), F.min("sim").alias("low")).orderBy("d", "cell").collect()  # a row per cell
    radius = {d: np.full(len(c), -1.0) for d, c in centroids.items()}
    first = {d: np.zeros(len(c), np.int64) for d, c in centroids.items()}  # first block of each cell
    parts = {d: np.zeros(len(c), np.int64) for d, c in centroids.items()}  # and how many it has
    filled: dict[int, int] = {}
    at_block: dict[int, int] = {}
    for r in cells:
        d, cell, n = r["d"], r["cell"], r["n"]
        radius[d][cell] = math.acos(max(-1.0, min(1.0, r["low"])))
        parts[d][cell] = -(-n // bin_rows)
        if d not in at_block or filled[d] + n > bin_rows:
            at_block[d], filled[d] = at_block.get(d, -1) + 1, 0
        first[d][cell] = at_block[d]
        at_block[d] += int(parts[d][cell]) - 1
        filled[d] += n if parts[d][cell] == 1 else bin_rows
    extra = spark.sparkContext.broadcast((radius, first, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row to the pairs of its own block with each block that holds a cell it visits."""
        radius, first, parts = extra.value
        for batch in batches:
            for n, whole, units in (x for at in range(0, batch.num_rows, 4096) for x in per_length(batch.slice(at, 4096))):
                c, r = table.value[n], radius[n]
                reach = math.sin(angle) * min(1.0, spread / math.sqrt(n))
                blocks = int((first[n] + parts[n]).max())
                for part in chunks(len(units), len(c)):
                    own, u = whole.slice(part.start, part.stop - part.start), units[part]
                    sims = u @ c.T
                    home = own.column("cell").to_numpy()
                    gap = np.sqrt(np.maximum(0, 2 - 2 * (c[home] @ c.T)))
                    visit = (sims[np.arange(len(u)), home][:, None] - sims <= gap * reach + 1e-9) & (np.arccos(np.clip(sims, -1, 1)) <= r[None, :] + angle + 1e-6) & (r[None, :] >= 0)
                    visit[np.arange(len(u)), home] = True
                    ids, mult = own.column("no").to_numpy(), own.column("mult").to_numpy()
                    dealt_by = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    block = first[n][home] + (dealt_by % parts[n][home].astype(np.uint64)).astype(np.int64)
                    # each row once for each block that holds a part of a cell it visits, its own among them
                    row, cell = np.nonzero(visit & (parts[n] > 0)[None, :])
                    held = parts[n][cell]
                    begin = np.cumsum(held) - held
                    to = np.repeat(first[n][cell] - begin, held) + np.arange(held.sum())
                    row, to = np.divmod(np.unique(np.repeat(row, held) * blocks + to), blocks)
                    by = np.lexsort((row, to, block[row]))
                    row, to = row[by], to[by]
                    cuts = np.flatnonzero((np.diff(block[row]) != 0) | (np.diff(to) != 0)) + 1
                    x = matrix(own.column("x"))
                    with np.errstate(over="ignore"):
                        single = x.astype(np.float32)
                    wide = not (single == x).all()
                    x = x if wide else single
                    slices = np.split(row, cuts)
                    heads = np.concatenate(([0], cuts))
                    mine, theirs = block[row[heads]], to[heads]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "d": pa.array(np.full(len(slices), n, np.int32)),
                            "lb": pa.array(np.minimum(mine, theirs).astype(np.int32)),
                            "rb": pa.array(np.maximum(mine, theirs).astype(np.int32)),
                            "home": pa.array(mine <= theirs),
                            "wide": pa.array(np.full(len(slices), wide)),
                            "ids": pa.array([ids[i].tobytes() for i in slices], pa.binary()),
                            "mults": pa.array([mult[i].tobytes() for i in slices], pa.binary()),
                            "xs": pa.array([x[i].tobytes() for i in slices], pa.binary()),
                        }
                    )

    def side(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = group.column("d")[0].as_py()
        ids, mult = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("ids", "mults"))
        xs = [np.frombuffer(x, np.float64 if w else np.float32).reshape(-1, d).astype(np.float64) for x, w in zip(group.column("xs").to_pylist(), group.column("wide").to_pylist(), strict=True)]
        return ids, mult, unit(np.concatenate(xs))

    def multiply(group: pa.Table) -> pa.Table:
        empty = np.empty(0, np.int64)
        found = [(empty, empty, empty)]
        same = group.column("lb")[0].as_py() == group.column("rb")[0].as_py()
        is_left = group.column("home").to_numpy(zero_copy_only=False)
        if is_left.any() and (same or not is_left.all()):
            left = side(group.filter(pa.array(is_left)))
            right = left if same else side(group.filter(pa.array(~is_left)))
            for at in range(0, len(left[0]), block_rows):
                (ids_a, mult_a, a), (ids_b, mult_b, b) = (v[at : at + block_rows] for v in left), (v[at if same else 0 :] for v in right)
                near = a @ b.T >= threshold
                near &= ids_a[:, None] != ids_b[None, :]
                i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(i):
                    continue
                near = near[np.ix_(i, j)]
                to_a, to_b = near @ mult_b[j], mult_a[i] @ near
                if same:
                    to_b[j < len(a)] = 0  # counted as left rows
                hl, ul = forest(ids_a[i], ids_b[j], near)
                found += [(ids_a[i], hl, to_a), (ids_b[j], ul, to_b)]
        ids, roots, links = (np.concatenate(v) for v in zip(*found, strict=True))
        return pa.table({"id": pa.array(ids), "root": pa.array(roots), "links": pa.array(links)})

    dealt = homes.select("d", "cell", "no", "mult", "x").mapInArrow(deal, "d int, lb int, rb int, home boolean, wide boolean, ids binary, mults binary, xs binary")
    found = materialize(dealt.groupBy("d", "lb", "rb").applyInArrow(multiply, "id long, root long, links long"), "found")
    discard(homes)
    table.destroy()
    extra.destroy()
    links = found.groupBy("id").agg(F.sum("links").alias("_links"))
    comps = connected_components(found, "id", "root").select(F.col("id").alias("_cid"), "component")
    named = classes.select("_h1", "_h2", "no", "rep", "mult").join(links, F.col("no") == F.col("id"), "left").join(comps, F.col("no") == F.col("_cid"), "left").withColumn("_comp", F.coalesce("component", "no"))
    least = named.groupBy(F.col("_comp").alias("_of")).agg(F.min("rep").alias("_c"))
    named = named.join(least, F.col("_comp") == F.col("_of"))
    named = named.select(F.col("_h1").alias("_a"), F.col("_h2").alias("_b"), (F.coalesce("_links", F.lit(0)) + F.col("mult") - 1).alias("_n"), "_c")
    out = keyed.select("vec_id", "_h1", "_h2").join(named, (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")), "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
