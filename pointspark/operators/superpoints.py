"""Over-segmentation into superpoints and the split of merged components.

Superpoints minimise sum |f - p|^2 + strength * (weights of cut edges) over the neighbour graph by contraction:
starting from single points, in every round each region picks the neighbour whose merger lowers the energy most, and regions
that pick each other merge, until no merger lowers it. A connected component of the graph is one group in numpy, or, if
it is large, takes the same rounds as joins, so no border of tiles cuts a superpoint.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointspark.operators.filters import shift_to_origin
from pointspark.operators.graph import connected_components
from pointspark.operators.grid import decimate
from pointspark.operators.ranks import dense_ranks
from pointspark.operators.spatial import knn, label_lookup
from pointspark.shared import discard, materialize


def region_fusion(xyz: np.ndarray, edges: np.ndarray, weights: np.ndarray, strength: float) -> np.ndarray:
    """Region of each point, numbered by the regions' first points.

    Merging regions of sizes m, n and means p, q costs m n / (m + n) |p - q|^2 and saves strength * their border.
    """
    n = len(xyz)
    mean, size, member = xyz.astype(float).copy(), np.ones(n), np.arange(n)
    border: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in zip(edges, weights, strict=True):
        if a != b:
            border[a][b] = border[a].get(b, 0.0) + w
            border[b][a] = border[a][b]

    def gain(a: int, b: int) -> float:
        d = mean[a] - mean[b]
        return strength * border[a][b] - size[a] * size[b] / (size[a] + size[b]) * float(d @ d)

    version = np.zeros(n, np.int64)
    heap = [(-g, a, b, 0, 0) for a in range(n) for b in border[a] if a < b and (g := gain(a, b)) > 0]
    heapq.heapify(heap)
    while heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or member[a] != a or member[b] != b:
            continue
        mean[a] = (mean[a] * size[a] + mean[b] * size[b]) / (size[a] + size[b])
        size[a] += size[b]
        member[b] = a
        version[a] += 1
        for c, w in border[b].items():
            border[c].pop(b, None)
            if c != a:
                border[a][c] = border[a].get(c, 0.0) + w
                border[c][a] = border[a][c]
        border[b].clear()
        for c in border[a]:
            if (g := gain(a, c)) > 0:
                lo, hi = min(a, c), max(a, c)
                heapq.heappush(heap, (-g, lo, hi, int(version[lo]), int(version[hi])))
    root = member.copy()
    while (root != member[root]).any():
        root = member[root]
    return np.unique(root, return_inverse=True)[1]


def contract(xyz: np.ndarray, edges: np.ndarray, weights: np.ndarray, strength: float) -> np.ndarray:
    """Region of each point (its smallest point) by rounds: every region picks its best neighbour, and pairs that pick each other merge.

    The same energy as ``region_fusion``, whose single order of mergers no two tasks could share; ``contract_rounds``
    takes the same rounds as joins, so both give the same regions.
    """
    n = len(xyz)
    total, size, label = xyz.astype(float).copy(), np.ones(n), np.arange(n)
    u, v = np.minimum(edges[:, 0], edges[:, 1]), np.maximum(edges[:, 0], edges[:, 1])
    w = np.asarray(weights, float)
    while True:
        keep = u != v
        keys, at = np.unique(u[keep] * n + v[keep], return_inverse=True)
        w = np.bincount(at, w[keep], len(keys))
        u, v = keys // n, keys % n
        d = total[u] / size[u, None] - total[v] / size[v, None]
        gain = strength * w - size[u] * size[v] / (size[u] + size[v]) * (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        best = np.flatnonzero(gain > 0)
        if not len(best):
            return label
        best = best[np.lexsort((v[best], u[best], -gain[best]))]
        first = np.full(n, -1)
        ends = np.concatenate((u[best], v[best]))
        node, place = np.unique(np.stack((u[best], v[best]), axis=1).ravel(), return_index=True)
        first[node] = best[place // 2]
        pick = np.unique(first[ends])
        pick = pick[(first[u[pick]] == pick) & (first[v[pick]] == pick)]
        a, b = u[pick], v[pick]
        total[a] += total[b]
        size[a] += size[b]
        to = np.arange(n)
        to[b] = a
        label, u, v = to[label], to[u], to[v]
        u, v = np.minimum(u, v), np.maximum(u, v)


def contract_rounds(nodes: DataFrame, edges: DataFrame, strength: float) -> DataFrame:
    """``cloud_id, pid, label`` as ``contract`` has them, each round a few joins: for components that are too large for one task.

    ``nodes``: cloud_id, pid, x, y, z; ``edges``: cloud_id, u, v, w, with u < v and each pair once.
    """
    regions = materialize(nodes.select("cloud_id", F.col("pid").alias("id"), *[F.col(c).cast("double").alias("s" + c) for c in "xyz"], F.lit(1.0).alias("n")), "regions")
    edges = materialize(edges, "borders")
    merged = None
    while True:
        side = lambda end: regions.select("cloud_id", F.col("id").alias(end), F.col("n").alias(end + "n"), *[(F.col("s" + c) / F.col("n")).alias(end + c) for c in "xyz"])
        met = edges.join(side("u"), ["cloud_id", "u"]).join(side("v"), ["cloud_id", "v"])
        dx, dy, dz = (F.col("u" + c) - F.col("v" + c) for c in "xyz")
        gain = F.lit(float(strength)) * F.col("w") - F.col("un") * F.col("vn") / (F.col("un") + F.col("vn")) * (dx * dx + dy * dy + dz * dz)
        better = met.select("cloud_id", F.struct((-gain).alias("g"), "u", "v").alias("e")).filter("e.g < 0")
        picks = better.withColumn("end", F.explode(F.array("e.u", "e.v"))).groupBy("cloud_id", "end").agg(F.min("e").alias("e"))
        pairs = materialize(picks.groupBy("cloud_id", F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count("*").alias("k")).filter("k = 2").select("cloud_id", "u", "v"), "mergers")
        if pairs.isEmpty():
            break
        merged = pairs if merged is None else merged.unionByName(pairs)
        to = pairs.select("cloud_id", F.col("v").alias("id"), F.col("u").alias("to"))
        home = F.coalesce("to", "id")
        sums = regions.join(to, ["cloud_id", "id"], "left").groupBy("cloud_id", home.alias("id")).agg(*[F.sum(c).alias(c) for c in ("sx", "sy", "sz", "n")])
        moved = edges
        for end in "uv":
            moved = moved.join(to.select("cloud_id", F.col("id").alias(end), F.col("to").alias("_" + end)), ["cloud_id", end], "left").withColumn(end, F.coalesce("_" + end, end)).drop("_" + end)
        moved = moved.filter("u <> v").groupBy("cloud_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))
        last, regions, edges = (regions, edges), materialize(sums, "regions"), materialize(moved, "borders")
        discard(*last)
    if merged is None:
        return nodes.select("cloud_id", "pid", F.col("pid").alias("label"))
    return connected_components(nodes, merged.select("cloud_id", F.col("v").alias("src"), F.col("u").alias("dst")))


def superpoints(points: DataFrame, resolution: float = 0.15, k: int = 5, strength: float = 1.0, tile_points: int = 50_000) -> DataFrame:
    """``cloud_id, pid, init_segs``: superpoint ids from 0, compact in a cloud.

    Components of the neighbour graph of at most ``tile_points`` points are contracted in a task each, larger ones by
    joins; the regions are the same either way.
    """
    reps, inverse = decimate(shift_to_origin(points.select("cloud_id", "pid", "x", "y", "z")), resolution)
    reps = materialize(reps, "reps")
    near = materialize(knn(reps, k).select("cloud_id", "src", "dst"), "near")
    labels = materialize(connected_components(reps, near), "labels")
    n = labels.groupBy("cloud_id", "label").agg(F.count("*").alias("_n"))
    at = materialize(reps.join(labels, ["cloud_id", "pid"]).join(n, ["cloud_id", "label"]), "sized")
    edges = near.groupBy("cloud_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").cast("double").alias("w"))
    edges = materialize(edges.join(at.select("cloud_id", F.col("pid").alias("u"), "label", "_n"), ["cloud_id", "u"]), "borders")
    small = at.filter(F.col("_n") <= tile_points)
    rows = small.select("cloud_id", "label", "pid", "x", "y", "z", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w"))
    none = F.lit(None).cast("double")
    rows = rows.unionByName(edges.filter(F.col("_n") <= tile_points).select("cloud_id", "label", F.col("u").alias("pid"), none.alias("x"), none.alias("y"), none.alias("z"), F.col("v").alias("dst"), "w"))

    def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["dst"].isna()].sort_values("pid")
        links = pdf[pdf["dst"].notna()]
        ids = nodes["pid"].to_numpy()
        pairs = np.column_stack((np.searchsorted(ids, links["pid"]), np.searchsorted(ids, links["dst"].astype("int64"))))
        found = contract(nodes[["x", "y", "z"]].to_numpy(), pairs, links["w"].to_numpy(), strength)
        return pd.DataFrame({"cloud_id": nodes["cloud_id"].to_numpy(), "pid": ids, "label": ids[found]})

    fused = materialize(rows.groupBy("cloud_id", "label").applyInPandas(fuse, "cloud_id string, pid long, label long"), "fused")
    large = at.filter(F.col("_n") > tile_points).select("cloud_id", "pid", "x", "y", "z")
    if not large.isEmpty():
        fused = materialize(fused.unionByName(contract_rounds(large, edges.filter(F.col("_n") > tile_points).select("cloud_id", "u", "v", "w"), strength)), "fused")
    ranks = dense_ranks(fused, "cloud_id", "label", "init_segs")
    named = fused.join(ranks, ["cloud_id", "label"]).select("cloud_id", "pid", F.col("init_segs").alias("label"))
    return label_lookup(inverse, named).withColumnRenamed("label", "init_segs")


def init_segments(points: DataFrame, resolution: float = 0.15, k_stem: int = 5, stem_strength: float = 1.0, k_branch: int = 10, branch_strength: float = 1.0) -> DataFrame:
    """Superpoints of stems and of the rest, the rest numbered after the stems."""
    stem = materialize(superpoints(points.filter("stemcls > 0"), resolution, k_stem, stem_strength), "stem-segs")
    branch = superpoints(points.filter("stemcls <= 0"), resolution, k_branch, branch_strength)
    offset = stem.groupBy("cloud_id").agg((F.max("init_segs") + 1).alias("_o"))
    moved = branch.join(offset, "cloud_id", "left").select("cloud_id", "pid", (F.col("init_segs") + F.coalesce("_o", F.lit(0))).alias("init_segs"))
    return stem.unionByName(moved)


def digamma(x: np.ndarray | float) -> np.ndarray | float:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (small := x < 10).any():
        shift[small] -= 1 / x[small]
        x[small] += 1
    q = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, x), float, len(x))


def _log_b(log_det: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """Logarithm of the normalising constant of a Wishart distribution in three dimensions."""
    return -nu / 2 * log_det - 1.5 * nu * math.log(2) - 1.5 * math.log(math.pi) - sum(_lgamma((nu - i) / 2) for i in range(3))


def mixture_step(count: np.ndarray, first: np.ndarray, second: np.ndarray, spread: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Variational posterior of a mixture from its responsibilities' sums: ``const``, ``mean`` and ``form`` of each part, and the divergence from the prior.

    The log density of a point x in a part is const - (x - mean)' form (x - mean) / 2. The prior is that of a whole
    component of covariance ``spread`` about the origin: one observation, and Dirichlet weights of 1 / parts. A row may
    stand for ``times`` parts that are alike; its sums are those of one of them.
    """
    times = np.broadcast_to(np.asarray(times, float), count.shape)
    k, beta0, nu0 = times.sum(), 1.0, 3.0
    alpha0 = 1.0 / k
    alpha = alpha0 + count
    whole = float((times * alpha).sum())
    log_weight = digamma(alpha) - digamma(whole)
    apart = math.lgamma(whole) - math.lgamma(alpha0 * k) + float((times * (math.lgamma(alpha0) - _lgamma(alpha) + (alpha - alpha0) * log_weight)).sum())
    beta, nu = beta0 + count, nu0 + count
    own = first / np.where(count > 0, count, 1.0)[:, None]
    own[count <= 0] = 0.0
    scatter = spread + second + (beta0 * count / beta - count)[:, None, None] * (own[:, :, None] * own[:, None, :])
    low = np.linalg.cholesky((scatter + scatter.transpose(0, 2, 1)) / 2)
    inverse = np.linalg.inv(low)
    w = inverse.transpose(0, 2, 1) @ inverse
    log_det = -2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)
    log_det0 = np.full(1, -np.linalg.slogdet(spread)[1])
    mean, form = first / beta[:, None], nu[:, None, None] * w
    log_precision = sum(digamma((nu - j) / 2) for j in range(3)) + 3 * math.log(2) + log_det
    const = log_weight + log_precision / 2 - 1.5 * math.log(2 * math.pi) - 1.5 / beta
    each = 1.5 * (np.log(beta / beta0) + beta0 / beta - 1) + beta0 / 2 * np.einsum("ki,kij,kj->k", mean, form, mean)
    each += _log_b(log_det, nu) - _log_b(log_det0, np.full(1, nu0)) + (nu - nu0) / 2 * log_precision + nu / 2 * (np.einsum("ij,kji->k", spread, w) - 3)
    return const, mean, form, apart + float((times * each).sum())


#: Points of a block, responsibilities taken at once, and the logarithm below which exp() is 0 (its last positive value is at -745.13).
BLOCK, AT_ONCE, GONE = 256, 1 << 19, 746.0
_I, _J = [0, 0, 0, 1, 1, 2], [0, 1, 2, 1, 2, 2]


def _products(u: np.ndarray) -> np.ndarray:
    return u[:, _I] * u[:, _J]


class PointBlocks:
    """Points of a component in blocks of near ones, for ``mixture_sums``; points at one place are one row that counts as many."""

    def __init__(self, x: np.ndarray) -> None:
        x, inverse, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        todo, done = [np.arange(len(x))], []
        while todo:  # halved across the widest side
            at = todo.pop()
            if len(at) <= BLOCK:
                done.append(at)
                continue
            side, half = x[at, int(np.ptp(x[at], axis=0).argmax())], len(at) // 2
            order = np.argpartition(side, half)
            todo += [at[order[half:]], at[order[:half]]]
        done = [at for at in done if len(at)]
        order = np.concatenate([*done, np.empty(0, np.int64)])
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.ends = np.cumsum([0, *map(len, done)])
        self.place, self.weight = place[inverse.reshape(-1)], weight[order].astype(float)
        self.centre = np.array([(x[at].min(axis=0) + x[at].max(axis=0)) / 2 for at in done]).reshape(-1, 3)
        u = x[order] - np.repeat(self.centre, np.diff(self.ends), axis=0)
        self.reach = np.array([np.sqrt((u[a:b] ** 2).sum(axis=1).max()) for a, b in zip(self.ends, self.ends[1:])])
        self.terms = np.column_stack((np.ones(len(u)), u, _products(u)))

    def densities(self, const: np.ndarray, mean: np.ndarray, form: np.ndarray):
        """Rows, their block's centre, parts and the rows' log densities in these, block by block.

        A part is left out of a block only if its responsibility is 0 in doubles for all of its points: its bound from above
        is by ``GONE`` below the best part's from below.
        """
        if not len(self.centre):
            return
        low, wide = np.linalg.cholesky(form), np.sqrt(np.linalg.eigvalsh(form)[:, 2]) * (1 + 1e-9)
        middle = (self.centre.min(axis=0) + self.centre.max(axis=0)) / 2
        span = np.sqrt((np.square(self.centre - middle)).sum(axis=1)).max() + self.reach.max()
        least = (const - np.square(np.sqrt(np.square(np.einsum("ki,kij->kj", middle - mean, low)).sum(axis=1)) + wide * span) / 2).max()
        live = np.flatnonzero(const >= least - GONE - 1e-9 * abs(least))  # somewhere
        const, mean, form, low, wide = const[live], mean[live], form[live], low[live], wide[live]
        square = form[:, _I, _J] * np.where(np.equal(_I, _J), -0.5, -1.0)
        for b, (centre, reach) in enumerate(zip(self.centre, self.reach)):
            if b % 64 == 0:  # of a few blocks at once
                some = self.centre[b : b + 64]
                away = np.sqrt(sum(np.square((some[:, :1] - mean[:, 0]) * low[:, 0, j] + (some[:, 1:2] - mean[:, 1]) * low[:, 1, j] + (some[:, 2:] - mean[:, 2]) * low[:, 2, j]) for j in range(3)))
                span = self.reach[b : b + 64, None] * wide
                least = (const - np.square(away + span) / 2).max(axis=1)
                near = const - np.square(np.maximum(away - span, 0)) / 2 >= (least - GONE - 1e-9 * np.abs(least))[:, None]
            keep = np.flatnonzero(near[b % 64])
            d, own = centre - mean[keep], form[keep]
            pull = np.einsum("kij,kj->ik", own, d)
            w = np.concatenate(((const[keep] - (pull * d.T).sum(axis=0) / 2)[None], -pull, square[keep].T))
            step = max(16, AT_ONCE // len(keep))
            for at in range(self.ends[b], self.ends[b + 1], step):
                rows = slice(at, min(at + step, self.ends[b + 1]))
                yield rows, centre, live[keep], self.terms[rows] @ w


def mixture_sums(blocks: PointBlocks, const: np.ndarray, mean: np.ndarray, form: np.ndarray, times: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sums of responsibilities, of points and of their squares by them, and of the log densities, by part; and how many responsibilities were taken.

    Of a row that stands for ``times`` parts that are alike: the sums of one of them, but all of their log densities.
    """
    k, taken = len(const), 0
    times = np.broadcast_to(np.asarray(times, float), const.shape)
    count, first, second, bound = np.zeros(k), np.zeros((k, 3)), np.zeros((k, 6)), np.zeros(k)
    for rows, centre, keep, lp in blocks.densities(const + np.log(times), mean, form):
        taken += lp.size
        top = lp.max(axis=1)
        lp -= top[:, None]
        np.exp(lp, out=lp)
        whole = lp.sum(axis=1)
        share = blocks.weight[rows] / whole
        own = lp.T @ np.column_stack((blocks.terms[rows] * share[:, None], (top + np.log(whole)) * share))
        n, moved = own[:, 0], own[:, 1:4]
        count[keep] += n
        first[keep] += moved + n[:, None] * centre
        second[keep] += own[:, 4:10] + moved[:, _I] * centre[_J] + moved[:, _J] * centre[_I] + n[:, None] * (centre[_I] * centre[_J])
        bound[keep] += own[:, 10]
    full = np.empty((k, 3, 3))
    full[:, _I, _J] = full[:, _J, _I] = second / times[:, None]
    return count / times, first / times[:, None], full, bound, taken


def mixture_parts(blocks: PointBlocks, const: np.ndarray, mean: np.ndarray, form: np.ndarray) -> np.ndarray:
    """The row of the largest responsibility of each point, the first of equals."""
    best = np.empty(len(blocks.weight), np.int64)
    for rows, _, keep, lp in blocks.densities(const, mean, form):
        best[rows] = keep[lp.argmax(axis=1)]
    return best[blocks.place]


def nearest_forms(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``const``, ``mean`` and ``form`` of the parts that rounds begin with."""
    return np.zeros(len(seeds)), seeds, np.broadcast_to(NEAREST * np.eye(3), (len(seeds), 3, 3))


def without_gone(first: np.ndarray, times: np.ndarray, count: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of parts, their first part before their number, with those that no point belongs to as one: these stay alike from here on."""
    gone = count == 0
    if gone.sum() < 2:
        return first, times, count, *others
    keep, one = ~gone, int(gone.argmax())
    keep[one], times = True, times.copy()
    times[one] = times[gone].sum()
    return tuple(a[keep] for a in (first, times, count, *others))


def mixture_fit(blocks: PointBlocks, first: np.ndarray, times: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray], spread: np.ndarray, tolerance: float, before: float | None = None) -> np.ndarray:
    """The part of each point of a centred component, from the sums of a round and its bound on; ``first``: each row's first part."""
    n = blocks.weight.sum()
    while True:
        first, times, *sums = without_gone(first, times, *sums)
        const, mean, form, apart = mixture_step(*sums, spread, times)
        *sums, bound, _ = mixture_sums(blocks, const, mean, form, times)
        now = bound.sum() - apart
        if before is not None and (now - before) / n <= tolerance:
            return first[mixture_parts(blocks, const, mean, form)]
        before = now


#: Precision of the parts that rounds begin with: almost each point to its nearest base.
NEAREST = 2e6
_TERMS = ["xx", "xy", "xz", "yy", "yz", "zz"]
#: Points that one task takes at most.
MOST_POINTS = 1_000_000
_RUNNING, _ENDED, _FINISH = range(3)


def mixture_split(points: DataFrame, bases: DataFrame, tolerance: float = 1e-4, least_spread: float = 1e-6, whole: int = 50_000_000) -> DataFrame:
    """Splits components that hold several bases: ``cloud_id, pid, label, part``.

    A variational mixture of Gaussians with full covariances, one part for each base, begun with each point at its nearest
    base. A component of at most ``whole`` responsibilities (points times bases) is fitted in one task. Of larger ones chunks of about as
    many are summed in a task each, a round is one aggregation of the chunks' sums, and a component's posterior is one packed row;
    once at most ``whole`` of its responsibilities are not 0, one task goes on with it. A component's rounds end when its bound, which never falls, rises by no more than ``tolerance`` a point. A
    point's part is that of the largest responsibility, numbered in base order, ties to the smaller. Bases at one place stay
    alike in all rounds and are fitted once.
    ``points``: cloud_id, pid, x, y, z, label; ``bases``: cloud_id, label, loc_id, x, y, z.
    """
    key = ["cloud_id", "label"]
    many = bases.groupBy(*key).agg(F.count("*").alias("_k")).filter("_k > 1")
    mixed = points.join(many, key).select(*key, "_k", F.col("pid").cast("long").alias("pid"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    middle = mixed.groupBy(*key).agg(F.count("*").alias("n"), F.first("_k").alias("_k"), *[F.avg(c).alias("m" + c) for c in "xyz"])
    chunks = F.greatest(F.ceil(F.col("n") * F.col("_k") / F.lit(whole)), F.ceil(F.col("n") / F.lit(MOST_POINTS))).cast("int")
    middle = materialize(middle.withColumn("_chunks", chunks), "middles")
    chunk = F.pmod(F.xxhash64("pid"), F.col("_chunks")).cast("int")
    mixed = materialize(mixed.drop("_k").join(middle, key).select(*key, "pid", *[(F.col(c) - F.col("m" + c)).alias(c) for c in "xyz"], "_chunks", chunk.alias("_chunk")), "mixed")
    part = F.row_number().over(Window.partitionBy(*key).orderBy("loc_id")) - 1
    seeds = bases.join(middle, key).select(*key, part.alias("part"), "loc_id", *[(F.col(c).cast("double") - F.col("m" + c)).alias(c) for c in "xyz"], "_chunks")
    seeds = materialize(seeds, "seeds")
    kind = points.schema["label"].dataType.simpleString()
    named_key, split = f"cloud_id string, label {kind}", f"cloud_id string, label {kind}, pid long, part int"

    def place(rows: pa.Table) -> np.ndarray:
        return np.column_stack([rows.column(c).to_numpy() for c in "xyz"])

    def named(own: pa.Table, best: np.ndarray) -> pa.Table:
        return own.select([*key, "pid"]).append_column("part", pa.array(best, pa.int32()))

    def alike(at: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first part, place and number of the bases at each place, in the order of the first."""
        places, first, times = np.unique(place(at.sort_by("part")), axis=0, return_index=True, return_counts=True)
        order = np.argsort(first)
        return first[order], places[order], times[order].astype(float)

    def fit(own: pa.Table, at: pa.Table) -> pa.Table:
        if not own.num_rows:
            return named(own, np.empty(0, np.int64))
        x, (first, places, times) = place(own), alike(at)
        blocks = PointBlocks(x)
        sums = mixture_sums(blocks, *nearest_forms(places), times)[:3]
        return named(own, mixture_fit(blocks, first, times, sums, x.T @ x / len(x) + least_spread * np.eye(3), tolerance))

    small = mixed.filter("_chunks = 1").groupBy(*key).cogroup(seeds.filter("_chunks = 1").groupBy(*key)).applyInArrow(fit, split)
    pid = F.col("pid").cast(points.schema["pid"].dataType)
    out = lambda df: df.select("cloud_id", pid.alias("pid"), "label", "part")
    many_chunks = middle.filter("_chunks > 1").agg(F.sum("_chunks").alias("n")).head()["n"]
    if not many_chunks:
        return out(materialize(small, "parts"))
    mixed, seeds = mixed.filter("_chunks > 1"), seeds.filter("_chunks > 1")
    spread = mixed.groupBy(*key).agg(F.count("*").alias("n"), F.first("_chunks").alias("_chunks"), *[F.avg(F.col(t[0]) * F.col(t[1])).alias("c" + t) for t in _TERMS])
    # a component's state: by row the first part, the number of parts alike, and const, mean and form, or the sums if they are to be finished
    columns = [*key, "n", "_chunks", *["c" + t for t in _TERMS], "apart", "was", "stage", "state"]
    schema = f"{named_key}, n long, _chunks int, {', '.join(f'c{t} double' for t in _TERMS)}, apart double, was double, stage int, state binary"
    terms = ["count", "bound", *["s" + c for c in "xyz"], *["s" + t for t in _TERMS]]

    def packed(*arrays: np.ndarray) -> bytes:
        flat = [a[:, _I, _J] if a.ndim == 3 else a.reshape(len(a), -1) for a in arrays]
        return np.concatenate(flat, axis=1).astype(float).tobytes()

    def unpacked(of: pa.Table) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a = np.frombuffer(of.column("state")[0].as_py()).reshape(-1, 12)
        form = np.empty((len(a), 3, 3))
        form[:, _I, _J] = form[:, _J, _I] = a[:, 6:]
        return a[:, 0].astype(np.int64), a[:, 1], (a[:, 2], a[:, 3:6], form)

    def prior(of: pa.Table) -> np.ndarray:
        c = np.empty((3, 3))
        c[_I, _J] = c[_J, _I] = [of.column("c" + t)[0].as_py() for t in _TERMS]
        return c + least_spread * np.eye(3)

    def changed(of: pa.Table, **values) -> pa.Table:
        of = of.select([c for c in columns if c in of.column_names])
        for c, v in values.items():
            typed = pa.array([v], pa.binary() if c == "state" else pa.int32() if c == "stage" else pa.float64())
            of = of.set_column(of.column_names.index(c), c, typed) if c in of.column_names else of.append_column(c, typed)
        return of.select(columns)

    def begun(at: pa.Table, of: pa.Table) -> pa.Table:
        first, places, times = alike(at)
        return changed(of, apart=None, was=None, stage=_RUNNING, state=packed(first, times, *nearest_forms(places)))

    def summed(own: pa.Table, of: pa.Table) -> pa.Table:
        rows, values, labels = np.empty(0, np.int32), np.empty((0, len(terms))), own.select(key).slice(0, 0)
        if own.num_rows and of.num_rows:
            _, times, forms = unpacked(of)
            count, first, second, bound, taken = mixture_sums(PointBlocks(place(own)), *forms, times)
            rows = np.flatnonzero((count > 0) | (bound != 0))
            values = np.column_stack((count, bound, first, second[:, _I, _J]))[rows]
            # row -1: how many responsibilities were taken
            rows, values = np.append(rows, -1), np.concatenate((values, [[taken, *[0.0] * (len(terms) - 1)]]))
            labels = of.select(key).take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table([*labels.columns, pa.array(rows, pa.int32()), *map(pa.array, np.ascontiguousarray(values.T))], names=[*key, "row", *terms])

    def posterior(own: pa.Table, of: pa.Table) -> pa.Table:
        if not of.num_rows:
            return of.select(columns)
        first, times, _ = unpacked(of)
        at, values = own.column("row").to_numpy(), np.column_stack([own.column(c).to_numpy() for c in terms])
        every = np.zeros((len(first), len(terms)))
        every[at[at >= 0]] = values[at >= 0]
        taken, apart, was, n = values[at < 0, 0].sum(), *[of.column(c)[0].as_py() for c in ("apart", "was", "n")]
        now = None if apart is None else every[:, 1].sum() - apart
        if was is not None and (now - was) / n <= tolerance:
            return changed(of, stage=_ENDED)
        second = np.empty((len(first), 3, 3))
        second[:, _I, _J] = second[:, _J, _I] = every[:, 5:]
        first, times, *sums = without_gone(first, times, every[:, 0], every[:, 2:5], second)
        if taken <= whole and n <= MOST_POINTS:
            return changed(of, was=now, stage=_FINISH, state=packed(first, times, *sums))
        *forms, apart = mixture_step(*sums, prior(of), times)
        return changed(of, apart=apart, was=now, state=packed(first, times, *forms))

    def chosen(own: pa.Table, of: pa.Table) -> pa.Table:
        if not (own.num_rows and of.num_rows):
            return named(own.slice(0, 0), np.empty(0, np.int64))
        first, _, forms = unpacked(of)
        return named(own, first[mixture_parts(PointBlocks(place(own)), *forms)])

    def finished(own: pa.Table, of: pa.Table) -> pa.Table:
        if not (own.num_rows and of.num_rows):
            return named(own.slice(0, 0), np.empty(0, np.int64))
        first, times, sums = unpacked(of)
        return named(own, mixture_fit(PointBlocks(place(own)), first, times, sums, prior(of), tolerance, of.column("was")[0].as_py()))

    def by_chunks(states: DataFrame, f, schema: str) -> DataFrame:
        each = states.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        # a number of partitions of our own: chunks are few bytes and much work, and would be put together by their bytes
        own, each = (df.repartition(min(4 * many_chunks, 2000), *key, "_chunk").groupBy(*key, "_chunk") for df in (mixed, each))
        return own.cogroup(each).applyInArrow(f, schema)

    states, settled = materialize(seeds.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(begun, schema), "forms"), []
    while True:
        each = by_chunks(states, summed, f"{named_key}, row int, " + ", ".join(f"{c} double" for c in terms))
        sums = materialize(each.groupBy(*key, "row").agg(*[F.sum(c).alias(c) for c in terms]), "sums")
        now = materialize(sums.groupBy(*key).cogroup(states.groupBy(*key)).applyInArrow(posterior, schema), "forms")
        discard(states, sums)
        stages = {row["stage"] for row in now.select("stage").distinct().collect()}
        if _ENDED in stages:
            settled.append(by_chunks(now.filter(F.col("stage") == _ENDED), chosen, split))
        if _FINISH in stages:
            settled.append(mixed.groupBy(*key).cogroup(now.filter(F.col("stage") == _FINISH).groupBy(*key)).applyInArrow(finished, split))
        if _RUNNING not in stages:
            break
        states = now if len(stages) == 1 else materialize(now.filter(F.col("stage") == _RUNNING), "forms")
    for df in settled:
        small = small.unionByName(df)
    return out(materialize(small, "parts"))
