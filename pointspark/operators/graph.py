"""Graphs as edge rows ``cloud_id, src, dst, w``."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointspark.operators import components as cc
from pointspark.operators.aggregates import component_centroid, component_size
from pointspark.operators.grid import decimate, voxel_key
from pointspark.operators.ranks import dense_ranks
from pointspark.operators.spatial import cluster_min_distance, knn, knn_bounded
from pointspark.shared import discard, materialize


def symmetrize(edges: DataFrame) -> DataFrame:
    """Half the sum of both directions: a mutual edge keeps its mean weight, a one-way edge half of its weight."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))  # a union would search twice
    return edges.select("cloud_id", both.alias("e"), "w").groupBy("cloud_id", "e.src", "e.dst").agg((F.sum("w") / 2).alias("w"))


def connected_components(nodes: DataFrame, edges: DataFrame, ident: str = "pid") -> DataFrame:
    """``cloud_id, ident, label``: label = the component's smallest identifier; lone nodes are their own.

    Identifiers are taken per cloud: nodes are numbered by a pair key when there is more than one cloud.
    """
    clouds = edges.select("cloud_id").distinct().limit(2).count()
    if clouds < 2:
        found, rows = cc.connected_components(edges, "src", "dst"), nodes.count()
        dealt = lambda df, c: df.repartition(-(-rows // cc.DEALT), c) if rows > 4 * cc.DEALT else df
        return dealt(nodes.select("cloud_id", ident), ident).join(dealt(found, "id"), F.col(ident) == F.col("id"), "left").select("cloud_id", ident, F.coalesce("component", ident).alias("label"))
    # one key per (cloud, node); a component never spans clouds, so the smallest node of a key group is looked up after
    key = lambda c: F.xxhash64("cloud_id", c)
    found = cc.connected_components(edges.select(key("src").alias("src"), key("dst").alias("dst")), "src", "dst")
    keyed = nodes.select("cloud_id", ident, key(ident).alias("id")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = keyed.groupBy("cloud_id", "component").agg(F.min(ident).alias("label"))
    return keyed.join(low, ["cloud_id", "component"]).select("cloud_id", ident, "label")


def noise_clean(points: DataFrame, max_gap: float = 3.0, min_points: int = 100, resolution: float = 0.03, k: int = 10) -> DataFrame:
    """``cloud_id, pid, component``: the size in voxels of each point's component, 0 if below ``min_points``.

    Voxels are joined to their ``k`` nearest within ``max_gap`` voxels.
    """
    keyed = voxel_key(points.select("cloud_id", "pid", "x", "y", "z"), resolution, "min")
    cells = materialize(keyed.groupBy("cloud_id", "i", "j", "k").agg(F.min("pid").alias("rep")), "voxels")
    grid = cells.select("cloud_id", F.col("rep").alias("pid"), *[F.col(a).cast("double").alias(c) for a, c in zip("ijk", "xyz", strict=True)])
    edges = knn_bounded(grid, k, max_gap).select("cloud_id", "src", "dst")
    labels = connected_components(grid, edges)
    sized = component_size(labels, min_points).select("cloud_id", F.col("pid").alias("rep"), "component")
    return keyed.join(cells, ["cloud_id", "i", "j", "k"]).join(sized, ["cloud_id", "rep"]).select("cloud_id", "pid", "component")


def peak_extract(tops: DataFrame, k: int = 5, max_gap: float = 0.3, min_radius: float = 0.2, nms_threshold: float = 0.5) -> DataFrame:
    """Candidate tops (pid, x, y, z, radius) to peaks: groups of near neighbours, median radius, suppression."""
    from pointspark.operators.ranking import nms

    edges = knn(tops, k - 1).filter(F.col("dist") < max_gap).select("cloud_id", "src", "dst")
    labels = connected_components(tops, materialize(edges, "peak-edges"))
    named = tops.join(labels, ["cloud_id", "pid"])
    peaks = named.groupBy("cloud_id", F.col("label").alias("loc_id")).agg(*[F.avg(c).alias(c) for c in "xyz"], F.median("radius").alias("radius")).filter(F.col("radius") > min_radius)
    return nms(materialize(peaks, "peaks"), nms_threshold)


def node_graph(points: DataFrame, k: int, max_distance: float, crowns: bool = False, label: str = "label") -> DataFrame:
    """Edges between clusters: the ``k`` nearest by centroid (xy for stems, xyz for crowns), weighed by closest points.

    An edge stays if its closest points are nearer than ``max_distance`` in xy (crowns: and twice that in 3-D).
    """
    centres = materialize(component_centroid(points, label).withColumnRenamed(label, "pid"), "centres")
    near = knn(centres, k, "xyz" if crowns else "xy").select("cloud_id", "src", "dst")
    edges = cluster_min_distance(points, materialize(near, "near"), label).filter(F.col("d2") < max_distance)
    if crowns:
        edges = edges.filter(F.col("d3") < 2 * max_distance)
    return symmetrize(edges.select("cloud_id", "src", "dst", F.col("d3").alias("w")))


#: Edges that one task relaxes at most, more or less, and how many one task packs.
MOST_EDGES, PACKED_EDGES = 2_000_000, 1_000_000
_NO_NODE = -(1 << 63)
_PACKED = "cloud_id string, tile long, nodes binary, others binary, weights binary"


def _pack(batches: Iterator[pa.RecordBatch], at_once: int = PACKED_EDGES) -> Iterator[pa.RecordBatch]:
    """Edges (cloud_id, tile, node, other, w) as few rows: the columns of a tile's edges as the bytes of arrays."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        held.clear()
        clouds = rows.column("cloud_id").combine_chunks().dictionary_encode()
        code, tile = clouds.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows.column("tile").to_numpy()
        key = code * (tile.max() + 1) + tile
        order = np.argsort(key.astype(np.int16) if key.max() < 1 << 15 else key, kind="stable")  # sixteen bits are sorted by radix
        code, tile = code[order], tile[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (tile[1:] != tile[:-1]))))
        parts = [np.split(rows.column(c).to_numpy()[order], first[1:]) for c in ("node", "other", "w")]
        data = [pa.array([x.tobytes() for x in part], pa.binary()) for part in parts]
        return pa.RecordBatch.from_arrays([clouds.dictionary.take(pa.array(code[first])), pa.array(tile[first]), *data], ["cloud_id", "tile", "nodes", "others", "weights"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= at_once:
            yield packed()
    if held:
        yield packed()


def _relax(group: pa.Table, limit: float | None, whole: bool) -> pa.Table:
    """One tile: Dijkstra from what was sent to it; its nodes' state, and what it sends to nodes that are not its own.

    Rows of kind 0 are packed edges, 1 the state so far, 2 what was sent. A tile's own nodes are those that its edges begin
    at and those of its state, or, if it is the ``whole`` graph, all.
    """
    tile = group.column("tile")[0].as_py()
    edges, rows = (group.filter(pc.equal(group.column("kind"), 0)), group.filter(pc.greater(group.column("kind"), 0)))
    unpacked = lambda c, kind: np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in edges.column(c)]])
    begins, ends, weights = unpacked("nodes", np.int64), unpacked("others", np.int64), unpacked("weights", np.float64)
    kind, node, dist = (rows.column(c).to_numpy() for c in ("kind", "node", "dist"))
    target, prev = rows.column("target").fill_null(0).to_numpy(), rows.column("prev").fill_null(_NO_NODE).to_numpy()
    apart = rows.column("apart").to_numpy(zero_copy_only=False)
    ids = np.unique(np.concatenate((node, begins, ends if whole else ends[:0])))
    order = np.argsort(begins, kind="stable")
    first = np.searchsorted(begins[order], np.append(ids, ids[-1:] + 1)).tolist()
    ends, weights = ends[order], weights[order].tolist()
    inner = np.minimum(np.searchsorted(ids, ends), len(ids) - 1)
    inner = np.where(ids[inner] == ends, inner, -1).tolist()
    ends, at = ends.tolist(), np.searchsorted(ids, node)
    best: list = [(math.inf, 0, _NO_NODE)] * len(ids)
    for i in np.flatnonzero(kind == 1):
        best[at[i]] = (float(dist[i]), int(target[i]), int(prev[i]))
    heap = [(float(dist[i]), int(target[i]), int(prev[i]), int(at[i]), bool(apart[i])) for i in np.flatnonzero(kind == 2)]
    heapq.heapify(heap)
    sent: dict = {}
    while heap:
        d, t, p, n, far = heapq.heappop(heap)
        known = best[n][:2]
        if (d, t) == known and far and p < best[n][2]:
            best[n] = (d, t, p)  # as near by another way: the smaller node before it counts
        if (d, t) >= known:
            continue
        best[n] = (d, t, p)
        own = int(ids[n])
        for e in range(first[n], first[n + 1]):
            nd = d + weights[e]
            if limit is not None and nd > limit:
                continue
            if inner[e] >= 0:
                if (nd, t) <= best[inner[e]][:2]:
                    heapq.heappush(heap, (nd, t, own, inner[e], weights[e] > 0))
            else:
                found = (nd, t, own, weights[e] > 0)
                if ends[e] not in sent or found < sent[ends[e]]:
                    sent[ends[e]] = found
    out = [(int(ids[n]), *v, True, False) for n, v in enumerate(best) if v[0] < math.inf] + [(n, *v, True) for n, v in sent.items()]
    nodes, dists, targets, prevs, aparts, news = (list(c) for c in zip(*out, strict=True)) if out else ([],) * 6
    return pa.table({
        "cloud_id": pa.array([group.column("cloud_id")[0].as_py()] * len(out), pa.string()), "tile": pa.array([tile] * len(out), pa.int64()), "node": pa.array(nodes, pa.int64()), "dist": pa.array(dists, pa.float64()),
        "target": pa.array(targets, pa.int64()), "prev": pa.array([None if p == _NO_NODE else p for p in prevs], pa.int64()), "apart": pa.array(aparts, pa.bool_()), "sent": pa.array(news, pa.bool_()),
    })


def _tiled(edges: DataFrame, begin: DataFrame, counts: DataFrame, places: DataFrame | None, most: int) -> Callable[[DataFrame, str, int], DataFrame]:
    """What adds ``tile`` to rows by a column of nodes, dealt to a number of tasks: about ``most`` edges a tile, by place in xy or, without places, by ranges of numbers."""
    parts = F.ceil(F.col("n") / F.lit(most)).cast("long")
    if places is None:
        ends = edges.groupBy("cloud_id").agg(F.least(F.min("src"), F.min("dst")).alias("lo"), F.greatest(F.max("src"), F.max("dst")).alias("hi"))
        ends = ends.unionByName(begin.groupBy("cloud_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")))
        span = materialize(ends.groupBy("cloud_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(counts, "cloud_id", "left"), "tiles")
        share = lambda c: (F.col(c) - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1).cast("double")
        return lambda rows, c, tasks: rows.join(F.broadcast(span), "cloud_id").withColumn("tile", F.coalesce(F.floor(share(c) * parts).cast("long"), F.lit(0))).drop("lo", "hi", "n")
    span = places.groupBy("cloud_id").agg(*[F.min(a).alias("lo" + a) for a in "xy"], F.greatest(*[F.max(a) - F.min(a) for a in "xy"], F.lit(1e-300)).alias("wide"))
    sides = F.ceil(F.sqrt(parts)).cast("long")
    i, j = (F.least(F.floor((F.col(a) - F.col("lo" + a)) / F.col("wide") * sides), sides - 1).cast("long") for a in "xy")
    placed = places.select("cloud_id", "node", "x", "y").join(F.broadcast(span.join(counts, "cloud_id")), "cloud_id")
    tiles = materialize(placed.select("cloud_id", "node", (i * sides + j).alias("tile")), "tiles")

    def by_place(rows: DataFrame, c: str, tasks: int) -> DataFrame:
        own = tiles.withColumnRenamed("node", c).repartition(tasks, "cloud_id", c).hint("shuffle_hash")
        return rows.repartition(tasks, "cloud_id", c).join(own, ["cloud_id", c], "left").withColumn("tile", F.coalesce("tile", F.lit(0)))

    return by_place


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float | None = None, places: DataFrame | None = None, most: int = MOST_EDGES) -> DataFrame:
    """``cloud_id, node, dist, target, prev`` from the nearest source (``cloud_id, node, target``), target the first of equals.

    The graph is cut to tiles of about ``most`` edges, by ``places`` (cloud_id, node, x, y; a node once) where they are given. In a
    round each tile that was sent a better distance runs Dijkstra's search over its own edges in one task and sends on what
    crosses its border. So rounds grow with the tiles that a path crosses, not with its edges; a graph of one tile takes one.
    Edges are dealt by their first node once, to learn its tile, and packed there; rounds move packed edges only.
    The state is one row a node, whatever the number of sources, and a tile's is written only when it has run.
    """
    whole_row = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("w").isNotNull()
    edges = edges.select("cloud_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).filter(whole_row)
    counts = edges.groupBy("cloud_id").agg(F.count("*").alias("n"))
    begin = sources.select("cloud_id", F.col("node").cast("long").alias("node"), F.col("target").cast("long").alias("target"))
    sizes = counts.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    whole = (sizes["most"] or 0) <= most
    if whole:
        tiled = lambda rows, c, tasks: rows.withColumn("tile", F.lit(0).cast("long"))
    else:
        tiled = _tiled(edges, begin, materialize(counts, "counts"), places, most)
    tasks = -(-(sizes["all"] or 1) // PACKED_EDGES)
    cut = tiled(edges, "src", tasks).select("cloud_id", "tile", F.col("src").alias("node"), F.col("dst").alias("other"), "w")
    held = cut.mapInArrow(_pack, _PACKED)
    held = (held if whole else materialize(held, "packed-edges")).withColumn("kind", F.lit(0))
    none, cols = F.lit(None).cast("long"), ["cloud_id", "tile", "node", "dist", "target", "prev", "apart"]
    first = tiled(begin.select("cloud_id", "node", "target"), "node", tasks)
    sent = materialize(first.withColumns({"dist": F.lit(0.0), "prev": none, "apart": F.lit(True)}).select(*cols), "sent")
    kinds = "cloud_id string, tile long, node long, dist double, target long, prev long, apart boolean, sent boolean"
    row = lambda df, kind: df.select(*cols).withColumn("kind", F.lit(kind))
    states, latest, number = None, None, 0
    while True:
        active = sent.select("cloud_id", "tile").distinct()
        rows = held.join(active, ["cloud_id", "tile"], "left_semi").unionByName(row(sent, 2), allowMissingColumns=True)
        if states is not None:
            rows = rows.unionByName(row(states.join(latest, ["cloud_id", "tile", "round"], "left_semi").join(active, ["cloud_id", "tile"], "left_semi"), 1), allowMissingColumns=True)
        out = materialize(rows.groupBy("cloud_id", "tile").applyInArrow(lambda group: _relax(group, limit, whole), kinds), "relaxed")
        own = out.filter("not sent").drop("sent").withColumn("round", F.lit(number))
        ran = own.select("cloud_id", "tile", "round").distinct()
        states = own if states is None else states.unionByName(own)
        latest = ran if latest is None else latest.unionByName(ran).groupBy("cloud_id", "tile").agg(F.max("round").alias("round"))
        latest = materialize(latest, "latest") if number else latest
        state = states.join(latest, ["cloud_id", "tile", "round"], "left_semi").select("cloud_id", "node", "dist", "target", "prev") if number else own.select("cloud_id", "node", "dist", "target", "prev")
        news = out.filter("sent")
        if news.isEmpty():
            return state
        best = news.groupBy("cloud_id", "node").agg(F.min(F.struct("dist", "target", "prev", "apart")).alias("b"))
        known = state.select("cloud_id", "node", F.struct("dist", "target", "prev").alias("k"))
        # a way of no length leads to no node as near from which it may have come
        better = best.join(known, ["cloud_id", "node"], "left").filter(F.col("k").isNull() | (F.struct("b.dist", "b.target") < F.struct("k.dist", "k.target")) | ((F.struct("b.dist", "b.target") == F.struct("k.dist", "k.target")) & F.col("b.apart") & (F.col("b.prev") < F.col("k.prev"))))
        last, sent = sent, materialize(tiled(better.select("cloud_id", "node", "b.dist", "b.target", "b.prev", "b.apart"), "node", tasks).select(*cols), "sent")
        discard(last)
        number += 1
        if sent.isEmpty():
            return state


def nearest_source_label(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``cloud_id, node, label``: the nearest source's rank, compacted to 0.. in each cloud; -1 where none is reachable.

    If ``nodes`` has x and y, the graph is cut by them.
    """
    reached = materialize(shortest_paths(edges, sources, places=nodes if {"x", "y"} <= set(nodes.columns) else None), "reached")
    ranks = dense_ranks(reached, "cloud_id", "target", "label")
    named = reached.join(ranks, ["cloud_id", "target"]).select("cloud_id", "node", "label")
    return nodes.select("cloud_id", "node").join(named, ["cloud_id", "node"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def touching_segments(points: DataFrame, k: int = 6, bound: float = 0.03, segment: str = "segment") -> DataFrame:
    """Pairs of segments with points that are neighbours, both directions found alone kept as they are."""
    near = knn_bounded(points, k, bound)
    named = points.select("cloud_id", "pid", F.col(segment).alias("s"))
    pairs = near.join(named.withColumnsRenamed({"pid": "src", "s": "a"}), ["cloud_id", "src"]).join(named.withColumnsRenamed({"pid": "dst", "s": "b"}), ["cloud_id", "dst"])
    return pairs.filter("a <> b").select("cloud_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def weight_shaping(edges: DataFrame, touching: DataFrame, cutoff: float, touch_scale: float = 0.03, stems: DataFrame | None = None, only_touching: bool = False) -> DataFrame:
    """Weights of centroid distances: touching pairs (scale * d)^2, edges between two stems and beyond ``cutoff`` gone."""
    from pointspark.operators.sets import union_reverse_pairs
    from pointspark.operators.spatial import semi_pair_lookup

    out = semi_pair_lookup(edges, union_reverse_pairs(touching))
    if only_touching:
        out = out.filter("touches")
    shaped = F.when(F.col("touches"), F.pow(F.col("w") * touch_scale, F.lit(2.0))).otherwise(F.col("w"))
    out = out.withColumn("w", shaped).filter(F.col("w") <= cutoff)
    if stems is not None:
        marks = stems.filter("is_stem > 0").select("cloud_id", F.col("segment").alias("src"), F.lit(True).alias("_a"))
        out = out.join(marks, ["cloud_id", "src"], "left").join(marks.withColumnsRenamed({"src": "dst", "_a": "_b"}), ["cloud_id", "dst"], "left")
        out = out.filter(F.col("_a").isNull() | F.col("_b").isNull())
    return out.select("cloud_id", "src", "dst", "w")


def find_stem(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """``cloud_id, seq, node_id`` of the stem, bottom to top: from the lowest stem segment to the farthest reachable one.

    ``segments``: segment, x, y, z, is_stem; ``edges`` between stem segments. The back-trace doubles its steps, so
    its rounds are the logarithm of the stem's length.
    """
    from pointspark.operators.ranking import lowest_start

    start = lowest_start(segments)
    sources = start.select("cloud_id", F.col("start").alias("node"), F.lit(0).alias("target"))
    paths = shortest_paths(edges, sources)
    paths = materialize(paths, "stem-paths")
    tip = paths.groupBy("cloud_id").agg(F.max_by("node", F.struct(F.col("dist"), -F.col("node"))).alias("node"))
    # after each round the nodes found are twice as many, and every node knows the one twice as far below it
    found, jump, size = materialize(tip.withColumn("back", F.lit(0)), "stem"), paths.filter("prev is not null").select("cloud_id", "node", F.col("prev").alias("down")), 1
    while True:
        more = found.join(jump, ["cloud_id", "node"]).select("cloud_id", F.col("down").alias("node"), (F.col("back") + size).alias("back"))
        wider = materialize(found.unionByName(more), "stem")
        before, after = (df.count() for df in (found, wider))
        found = wider
        if before == after:
            break
        jump = materialize(jump.join(jump.select("cloud_id", F.col("node").alias("down"), F.col("down").alias("_d")), ["cloud_id", "down"]).select("cloud_id", "node", F.col("_d").alias("down")), "jump")
        size *= 2
    length = found.groupBy("cloud_id").agg(F.max("back").alias("_n"))
    return found.join(length, "cloud_id").select("cloud_id", (F.col("_n") - F.col("back")).cast("int").alias("seq"), F.col("node").alias("node_id"))


def decimated_components(points: DataFrame, resolution: float, k: int = 10, reach: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decimated points with ``label``, their edges, and the inverse of the decimation."""
    reps, inverse = decimate(points, resolution)
    reps = materialize(reps, "reps")
    edges = materialize(knn_bounded(reps, k, reach * resolution).select("cloud_id", "src", "dst", F.col("dist").alias("w")), "near")
    labels = connected_components(reps, edges)
    return reps.join(labels, ["cloud_id", "pid"]), edges, inverse
