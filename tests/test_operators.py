"""Operators on small clouds worked out by hand, and against plain versions."""

import heapq
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointspark.functions import scalar
from pointspark.operators import aggregates, filters, graph, grid, predict, qsm, ranking, raster, segment, spatial, superpoints
from pointspark.plans import catalog
from pointspark.schema import require_columns
from pointspark.sources import las, mesh, models, text
from pointspark.sources.points import child_cloud, points, upsert_field
from pointspark.streaming.tiles import foreach_cloud, running_cell_min


PATHS = "cloud_id string, path_id int, seq int, node_id long"


def cloud(spark, rows, **fields):
    names = ", ".join(f"{k} {v[0]}" for k, v in fields.items())
    rows = [("c", i, *map(float, r), *(v[1][i] for v in fields.values())) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, f"cloud_id string, pid long, x double, y double, z double{', ' + names if names else ''}")


def edges(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "cloud_id string, src long, dst long, w double")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_missing_columns_name_the_producer(spark):
    with pytest.raises(ValueError, match="treefilter.*component_filter"):
        filters.filter_above_ground(cloud(spark, [(0, 0, 0)]))
    assert require_columns(cloud(spark, [(0, 0, 0)]), "x")


def test_upsert_and_child(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1)], f=("int", [5, 6]))
    new = spark.createDataFrame([("c", 1, 9)], "cloud_id string, pid long, f int")
    assert values(upsert_field(p, new, "f"), "pid", "f") == [(0, 0), (1, 9)]
    with pytest.raises(ValueError, match="no child"):
        child_cloud(p, spark.createDataFrame([("other", 1)], "cloud_id string, loc_id long"))


def test_guards(spark):
    p = cloud(spark, [(0, 0, 0), (10, 10, 0)])
    with pytest.raises(ValueError):
        filters.guard_min_points(p, 3)
    assert filters.guard_min_points(p, 3, confirm=lambda n: n == 2) is p
    with pytest.raises(ValueError):
        filters.guard_block_count(p, 10, 10, most=50)
    assert filters.block_count(p, 100, 100).first()["n_blocks"] == 0


@pytest.mark.parametrize("overlap", [0.0, 0.1, 0.4])
def test_sliding_blocks_equal_the_definition(spark, overlap):
    rng = np.random.default_rng(3)
    xyz = np.round(rng.uniform(0, 37, (80, 3)), 2)
    got = values(grid.sliding_blocks(cloud(spark, xyz), (10.0, 12.0, 50.0), overlap), "pid", "block_id")
    want, dims = [], []
    low, ext = xyz.min(axis=0), xyz.max(axis=0) - xyz.min(axis=0)
    for e, b in zip(ext, (10.0, 12.0, 50.0), strict=True):
        dims.append(max(1, math.floor((e - b) / (b * (1 - overlap))) + 2))
    for pid, p in enumerate(xyz):
        for i in range(dims[0]):
            for j in range(dims[1]):
                for k in range(dims[2]):
                    s = low + np.array([i * 10.0 * (1 - overlap), j * 12.0 * (1 - overlap), k * 50.0 * (1 - overlap)])
                    if all(s[a] <= p[a] < s[a] + b for a, b in enumerate((10.0, 12.0, 50.0))):
                        want.append((pid, (i * dims[1] + j) * dims[2] + k))
    assert got == sorted(want) and {p for p, _ in got} == set(range(80))


def test_flat_cloud_keeps_its_blocks_apart(spark):
    p = cloud(spark, [(0, 0, 0), (30, 0, 0.1), (0, 30, 0.2)])
    ids = [b for _, b in values(grid.sliding_blocks(p, (10.0, 10.0, 10.0), 0.1), "pid", "block_id")]
    assert len(set(ids)) == 3 and min(ids) >= 0


def test_block_voxels_move_with_the_block(spark):
    p = cloud(spark, [(0, 0, 5), (1, 1, 6), (3, 0, 9)]).withColumn("block_id", F.lit(0).cast("long"))
    moved = p.withColumns({c: F.col(c) + 100.0 for c in "xyz"})
    one, two = (values(grid.block_voxelize(d, (1.0, 1.0, 1.0), (3, 3, 9)), "pid", "voxel") for d in (p, moved))
    assert one == two == [(0, 0), (1, 37)]


def test_raster_edges(spark):
    p = cloud(spark, [(0, 0, 1), (4, 4, 2), (1, 3, 3)])
    assert len(values(grid.raster_key_upperleft(p, 2.0), "pid")) == 1
    assert values(grid.raster_key_lowerleft(p, 2.0), "pid", "row", "col") == [(0, 0, 0), (1, 2, 2), (2, 1, 0)]


def test_neighbours_are_strict_and_ties_go_to_the_smaller(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (3, 0, 0)])
    near = values(spatial.knn_bounded(p, 5, 2.0), "src", "dst", "rank")
    assert (1, 3, 2) not in near and (0, 1, 1) in near and (0, 2, 2) in near
    assert values(spatial.knn(p, 1), "src", "dst") == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_unbounded_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate((rng.normal(0, 1, (60, 3)), rng.normal(500, 0.1, (5, 3)), [[9000, 0, 0]]))
    got = values(spatial.knn(cloud(spark, xyz), 3), "src", "rank", "dst")
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == sorted((i, r + 1, int(j)) for i in range(len(xyz)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3]))


def test_symmetrize(spark):
    e = edges(spark, [(1, 2, 4.0), (2, 1, 4.0), (2, 3, 4.0)])
    assert values(graph.symmetrize(e), "src", "dst", "w") == [(1, 2, 4.0), (2, 1, 4.0), (2, 3, 2.0), (3, 2, 2.0)]


def test_components_of_chains_and_clouds(spark):
    e = edges(spark, [(i, i + 1, 1.0) for i in range(40)] + [(100 + i, 101 + i, 1.0) for i in range(5)])
    nodes = spark.createDataFrame([("c", i) for i in [*range(41), *range(100, 106), 200]], "cloud_id string, pid long")
    labels = values(graph.connected_components(nodes, e), "pid", "label")
    assert {b for _, b in labels} == {0, 100, 200}
    other = e.unionByName(e.filter("src >= 100").withColumn("cloud_id", F.lit("d")))
    more = nodes.unionByName(nodes.withColumn("cloud_id", F.lit("d")))
    two = values(graph.connected_components(more, other), "cloud_id", "pid", "label")
    assert ("d", 103, 100) in two and ("d", 3, 3) in two and ("c", 3, 0) in two


def dijkstra(links, sources):
    dist = {}
    heap = [(0.0, s, s) for s in sorted(sources)]
    while heap:
        d, t, n = heapq.heappop(heap)
        if n not in dist:
            dist[n] = d, t
            for m, w in links.get(n, []):
                heapq.heappush(heap, (d + w, t, m))
    return dist


def test_nearest_sources_equal_dijkstra(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(1, 9, 90), strict=True) if a != b]
    rows = list({(a, b): (a, b, w) for a, b, w in rows}.values())
    links = {}
    for a, b, w in rows:
        links.setdefault(a, []).append((b, w))
    src = spark.createDataFrame([("c", n, n) for n in (3, 7, 20)], "cloud_id string, node long, target long")
    got = {n: (d, t) for n, d, t in values(graph.shortest_paths(edges(spark, rows), src), "node", "dist", "target")}
    assert got == dijkstra(links, [3, 7, 20])
    nodes = spark.createDataFrame([("c", i) for i in range(41)], "cloud_id string, node long")
    labels = dict(values(graph.nearest_source_label(nodes, edges(spark, rows), src), "node", "label"))
    assert labels[40] == -1 and labels[3] == 0


def greedy(tops, t=0.5):
    kept = []
    for i, x, y, z, r in sorted(tops, key=lambda p: (-p[3], p[0])):
        if all(math.hypot(x - a, y - b) > (r + q) * t for _, a, b, _, q in kept):
            kept.append((i, x, y, z, r))
    return sorted(k[0] for k in kept)


def test_suppression_equals_greedy(spark):
    rng = np.random.default_rng(2)
    tops = [(i, *map(float, np.round(rng.uniform(0, 12, 2), 1)), float(rng.integers(0, 6)), float(rng.uniform(0.5, 2))) for i in range(60)]
    df = spark.createDataFrame([("c", *t) for t in tops], "cloud_id string, loc_id long, x double, y double, z double, radius double")
    assert [i for (i,) in values(ranking.nms(df), "loc_id")] == greedy(tops)
    pair = spark.createDataFrame([("c", 1, 0.0, 0.0, 5.0, 1.0), ("c", 2, 1.0, 0.0, 6.0, 1.0)], df.schema)
    assert values(ranking.nms(pair), "loc_id") == [(2,)]  # equality suppresses
    assert ranking.nms(df.limit(0)).count() == 0


def test_noise_clean_drops_small_components(spark):
    p = cloud(spark, [(0.0, 0, 0), (0.04, 0, 0), (0.08, 0, 0), (5, 5, 5)])
    assert values(graph.noise_clean(p, 3.0, 3, 0.03), "pid", "component") == [(0, 3), (1, 3), (2, 3), (3, 0)]


def test_tree_statistics_by_hand(spark):
    p = cloud(spark, [(0, 0, 2), (2, 0, 4), (1, 3, 9)], itc=("long", [1, 1, 1]), dtm_z=("double", [1.0, 0.0, 1.0]))
    r = aggregates.tree_stats(p).first()
    assert (r["x"], r["y"], r["z"], r["height"], r["area"]) == (1.0, 1.0, 9.0, 8.0, 0.0)
    square = [(x, y, 0) for x in (0, 2) for y in (0, 3)] + [(1, 1, 0)] * 4
    assert aggregates.hull_area(cloud(spark, square, itc=("long", [4] * 8))).first()["area"] == 6.0


def test_hulls_equal_the_edge_test():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = np.round(rng.uniform(0, 5, (12, 2)), 1)
        area = 0.0
        for a in p:
            for b in p:
                d = b - a
                if (d != 0).any():
                    side = d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])
                    line = p[np.abs(side) < 1e-12]
                    ends = line[[np.argmin(line @ d), np.argmax(line @ d)]]
                    if (side >= -1e-12).all() and (ends[0] == a).all() and (ends[1] == b).all():
                        area += (a[0] * b[1] - a[1] * b[0]) / 2
        once = area / max(1, 1)
        assert aggregates.hull_area_of(p[:, 0], p[:, 1]) == pytest.approx(once) or len(np.unique(p, axis=0)) < len(p)


def test_median_filter_pads_with_zero(spark):
    rows = [("c", 1, i, float(r)) for i, r in enumerate([5, 1, 9, 3])] + [("c", 2, i, float(r)) for i, r in enumerate([5, 1, 9])]
    df = spark.createDataFrame(rows, "cloud_id string, path_id int, seq int, radius double")
    assert [r for _, _, r in values(ranking.median_filter_3(df), "path_id", "seq", "radius")] == [1, 5, 3, 3, 5, 1, 9]


def test_mode_and_preserved_labels(spark):
    p = cloud(spark, [(0, 0, 0)] * 6, blob=("long", [1, 1, 1, 1, 2, 2]), lab=("long", [3, 2, 2, 3, 0, 0]))
    assert values(aggregates.mode_positive(p, "lab", ("cloud_id", "blob")), "blob", "mode") == [(1, 2), (2, 0)]
    q = cloud(spark, [(0, 0, 0)] * 2, treeoff=("long", [4, 0]), pred=("long", [9, 9]))
    assert values(filters.preserve_existing(q), "pid", "pred") == [(0, 4), (1, 9)]


def test_superpoints_invariants(spark):
    rng = np.random.default_rng(4)
    xyz = np.concatenate((rng.normal(0, 0.3, (40, 3)), rng.normal(6, 0.3, (30, 3))))
    p = cloud(spark, xyz)
    one = dict(values(superpoints.superpoints(p, 0.0001, 4, 1e9), "pid", "init_segs"))
    every = dict(values(superpoints.superpoints(p, 0.0001, 4, 0.0), "pid", "init_segs"))
    some = dict(values(superpoints.superpoints(p, 0.0001, 4, 0.1), "pid", "init_segs"))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    part = np.arange(70)
    for i in range(70):  # the graph of four neighbours falls into this many parts
        for j in np.argsort(d[i], kind="stable")[1:5]:
            part[part == part[j]] = part[i]
    assert len(set(every.values())) == 70 and len(set(one.values())) == len(set(part))
    assert 2 <= len(set(some.values())) <= 70 and set(some) == set(range(70))
    assert all(len({one[i] for i in range(70) if some[i] == s}) == 1 for s in set(some.values()))


def test_mixture_split_follows_the_bases(spark):
    xyz = [(i * 0.1, 0, 0) for i in range(10)] + [(5 + i * 0.1, 0, 0) for i in range(10)]
    p = cloud(spark, xyz, label=("long", [0] * 20))
    bases = spark.createDataFrame([("c", 0, 1, 0.0, 0.0, 0.0), ("c", 0, 2, 5.0, 0.0, 0.0)], "cloud_id string, label long, loc_id long, x double, y double, z double")
    parts = dict(values(superpoints.mixture_split(p, bases), "pid", "part"))
    assert all(parts[i] == (i >= 10) for i in range(20))


def stems(spark):
    """Two vertical stems, some distance apart, with a base each, and ground between."""
    rows = [(0, 0, 0.1 * i) for i in range(30)] + [(4, 0, 0.1 * i) for i in range(30)] + [(2, 0, 0)]
    p = cloud(spark, rows, stemcls=("int", [2] * 60 + [1]))
    bases = spark.createDataFrame([("c", 7, 0.0, 0.0, 0.0), ("c", 9, 4.0, 0.0, 0.0)], "cloud_id string, loc_id long, x double, y double, z double")
    return p, bases


def test_stem_clusters(spark):
    p, bases = stems(spark)
    got = dict(values(segment.stem_clusters(p, bases, 0.06, 0.3), "pid", "stemoff"))
    assert [got[0], got[29], got[30], got[59], got[60]] == [1, 1, 2, 2, 0]


def test_crown_clusters(spark):
    p = cloud(spark, [(0, 0, 0), (0.1, 0, 0), (0.3, 0, 0), (0.4, 0, 0), (9, 0, 0)], init_segs=("long", [0, 0, 1, 1, 2]), treeoff=("long", [5, 0, 0, 0, 0]))
    assert values(segment.crown_clusters(p, 0.01, 0.3), "pid", "itc") == [(0, 5), (1, 5), (2, 5), (3, 5), (4, 0)]


def test_node_radius_of_an_exact_circle(spark):
    rows, segs = [], []
    for s in range(5):
        for a in np.linspace(0, 2 * np.pi, 12, endpoint=False):
            rows.append((0.5 * np.cos(a), 0.5 * np.sin(a), s))
            segs.append(s)
    rows, segs = [*rows, (0, 0, 5), (0, 0, 5)], [*segs, 5, 5]
    p = cloud(spark, rows, init_segs=("long", segs), stemcls=("int", [1] * len(rows)))
    paths = spark.createDataFrame([("c", 0, i, i) for i in range(6)], PATHS)
    got = values(qsm.node_radius(p, paths, qsm.segments_of(p)), "seq", "radius")
    assert [round(r, 6) for _, r in got[:5]] == [0.5] * 5 and got[5][1] == pytest.approx(0.04)


def test_skeleton_of_a_stem_with_a_branch(spark):
    rows, segs, cls = [], [], []
    for s in range(6):
        rows += [(0.01 * i, 0, s * 0.1 + 0.02 * i) for i in range(6)]
        segs += [s] * 6
        cls += [1] * 6
    for s in range(3):
        rows += [(0.07 + 0.1 * s + 0.02 * i, 0, 0.3 + 0.01 * i) for i in range(6)]
        segs += [6 + s] * 6
        cls += [0] * 6
    p = cloud(spark, rows, init_segs=("long", segs), stemcls=("int", cls))
    nodes, segments, labels = qsm.qsm(p, 4, 40.0, 0.08, 0.4)
    by = {}
    for path, _, n in values(nodes, "path_id", "seq", "node_id"):
        by.setdefault(path, []).append(n)
    assert by[0] == [0, 1, 2, 3, 4, 5]
    assert [6, 7, 8] in [v[1:] for k, v in by.items() if k]
    assert dict(values(labels, "segment", "label"))[0] == 1
    names = [r["name"] for r in qsm.emit_polylines(nodes).orderBy("path_id").collect()]
    assert names[:2] == ["Stem", "Branch_1"]


def test_clean_tree_and_path_tree(spark):
    segs = spark.createDataFrame([("c", i, 0.0, 0.0, 0.0, n, 0) for i, n in enumerate([9, 9, 5, 6])], "cloud_id string, segment long, x double, y double, z double, n long, is_stem int")
    paths = spark.createDataFrame([("c", 0, 0, 0), ("c", 0, 1, 1), ("c", 1, 0, 0), ("c", 1, 1, 2), ("c", 2, 0, 1), ("c", 2, 1, 3)], PATHS)
    assert {p for p, in values(qsm.clean_tree(paths, segs), "path_id")} == {0, 2}
    e = edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (1, 3, 5.0), (3, 4, 1.0)])
    roots = spark.createDataFrame([("c", 0)], "cloud_id string, node long")
    assert values(qsm.path_tree(e, roots), "path_id", "seq", "node_id") == [(1, 0, 0), (1, 1, 1), (1, 2, 3), (1, 3, 4), (2, 0, 1), (2, 1, 2)]


def test_path_tree_of_a_random_tree(spark):
    """Every node is on the path of the farthest node below it; roots begin paths; ties go to the smaller node."""
    rng = np.random.default_rng(2)
    up = {i: int(rng.integers(max(0, i - 6), i)) for i in range(2, 90)}  # 0 and 1 are roots
    links = [(a, b, float(rng.integers(1, 4))) for b, a in up.items()]
    dist = {0: 0.0, 1: 0.0}
    for a, b, w in links:
        dist[b] = dist[a] + w
    lead = {i: i for i in up}
    for i in sorted(up, reverse=True):
        if up[i] in lead:
            lead[up[i]] = min(lead[up[i]], lead[i], key=lambda n: (-dist[n], n))
    want = []
    for at, leaf in enumerate(sorted(set(lead.values()), key=lambda n: (-dist[n], n))):
        own = sorted((i for i in up if lead[i] == leaf), key=lambda n: dist[n])
        want += [(5 + at, seq, n) for seq, n in enumerate([up[own[0]], *own])]
    known = spark.createDataFrame([("c", 4, 0, 0)], PATHS)
    roots = spark.createDataFrame([("c", 0), ("c", 1)], "cloud_id string, node long")
    assert values(qsm.path_tree(edges(spark, links), roots, 1e9, known), "path_id", "seq", "node_id") == want


def test_tubes(spark, tmp_path):
    schema = "cloud_id string, path_id int, seq int, node_id long, x double, y double, z double, radius double"
    rows = [("c", 0, i, i, 0.0, 0.0, float(i), 0.2) for i in range(2)] + [("c", 1, i, i, 0.0, 0.0, float(i), 1.0) for i in range(6)] + [("c", 2, i, i, *p) for i, p in enumerate([(0.0, 0.0, 0.0, 1.0), (2.0, 0.0, 0.0, 2.0), (2.0, 2.0, 0.0, 4.0)])]
    got = {k: [r[1:] for r in values(qsm.tube_samples(spark.createDataFrame([*rows, ("c", 3, 0, 0, 0.0, 0.0, 0.0, 1.0)], schema), 0.5 if k < 2 else 1.0).filter(f"path_id = {k}"), "i", "x", "y", "z", "radius")] for k in range(4)}
    assert got[3] == [] and [p[2] for p in got[0]] == pytest.approx([-0.5, 0.0, 1.0, 1.5]) and {p[3] for p in got[0]} == {0.2}
    assert np.allclose([p[:2] for p in got[1]], 0) and got[1][-1][2] == pytest.approx(5.5)
    assert got[2][0] == (-1.0, 0.0, 0.0, 1.0) and got[2][-1] == (2.0, 3.0, 0.0, 4.0) and len(got[2]) == 6
    assert got[2][2] == pytest.approx((1.2, 0.0, 0.0, 1.6))  # two fifths of four legs: 0.6 of the second
    knots = np.array([0.0, 0.2, 0.5, 0.6, 1.0])
    at = np.column_stack((np.sin(5 * knots), knots**2))
    fine = np.linspace(0, 1, 2001)
    curve = qsm.spline(knots, at, fine)
    bend = np.diff(curve, 2, axis=0) / (fine[1] ** 2)
    assert np.allclose(qsm.spline(knots, at, knots), at) and np.abs(np.diff(bend, axis=0)).max() < 0.2 and np.abs(bend[[0, -1]]).max() < 0.2
    nodes = spark.createDataFrame([("c", 0, i, i, 0.0, 0.0, float(i), 0.3) for i in range(3)], "cloud_id string, path_id int, seq int, node_id long, x double, y double, z double, radius double")
    v, f = qsm.tube_mesh(qsm.tube_samples(nodes, 1.0), 8)
    at = v.toPandas()
    assert np.allclose(np.hypot(at["x"], at["y"]), 0.3) and f.count() == 8 * (at["vid"].max() // 8)
    mesh.write_obj(nodes, f"{tmp_path}/o", 1.0, 8)
    vs, fs = mesh.read_obj(spark, f"{tmp_path}/o")
    low, high = fs.selectExpr("min(least(v1, v2, v3, v4))", "max(greatest(v1, v2, v3, v4))").first()
    assert low == 1 and high == vs.count() == len(at)


def test_tube_queries_mesh_every_sample(spark):
    d = "/root/testdata/sf0.01"
    n = {r["path_id"]: r["n"] for r in catalog._tree_paths(points(spark, d)).groupBy("path_id").agg(F.count("*").alias("n")).collect()}
    assert min(n.values()) > 50
    got = catalog.queries()
    counted = lambda name: {r["path_id"]: r["count"] for r in got[name](spark, d).groupBy("path_id").count().collect()}
    assert counted("tube_mesh_vertices") == {k: 8 * v for k, v in n.items()}
    faces = {(k, i * 8 + j, i * 8 + (j + 1) % 8, i * 8 + 8 + (j + 1) % 8, i * 8 + 8 + j) for k, v in n.items() for i in range(v - 1) for j in range(8)}
    assert {tuple(r) for r in got["tube_mesh_faces"](spark, d).collect()} == faces
    assert counted("drop_nan_vertices") == {k: 8 * (v - 1) - 2 for k, v in n.items()}  # but for the two faces at the first vertex


def test_xml_nests_branches():
    rows = [dict(path_id=p, seq=s, node_id=n, x=0.0, y=0.0, z=float(n), radius=0.1) for p, s, n in [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 2), (1, 1, 5), (2, 0, 5), (2, 1, 6)]]
    import xml.etree.ElementTree as ET

    root = ET.fromstring(mesh.tree_xml(rows))
    inner = root.find("branch/node[@id='2']/branch")
    assert inner.get("parent_node") == "2" and inner.get("level") == "2"
    assert inner.find("node[@id='5']/branch/node[@id='6']").get("prev_node") == "5"


def test_gaps_and_medians(spark):
    r = spark.createDataFrame([("c", 0, 0, 1.0), ("c", 0, 2, 4.0)], "cloud_id string, row long, col long, value double")
    shape = spark.createDataFrame([("c", 1, 3)], "cloud_id string, nrow long, ncol long")
    assert values(raster.fill_gaps(r, "idw", 5, shape), "col", "value") == [(0, 1.0), (1, 2.5), (2, 4.0)]
    assert values(raster.fill_gaps(r, "nearest", 5, shape), "col", "value")[1] == (1, 1.0)
    assert raster.fill_gaps(r, "none") is r
    assert values(raster.median_disk(r), "value") == [(2.5,), (2.5,)]
    assert len(raster.DISK) == 81
    with pytest.raises(ValueError):
        raster.fill_gaps(r, "quartic")


def test_regions(spark):
    cells = spark.createDataFrame([("c", a, b) for a, b in [(0, 0), (1, 1), (5, 5)]], "cloud_id string, row long, col long")
    assert values(raster.label_image(cells), "row", "col", "n") == [(0.5, 0.5, 2), (5.0, 5.0, 1)]


def test_dtm_is_flat_on_flat_ground(spark):
    rows = [(x + 0.5, y + 0.5, 3.0) for x in range(12) for y in range(12) if (x, y) != (5, 5)]
    p = cloud(spark, rows, treefilter=("int", [1] * len(rows)))
    out = raster.dtm(p, 1.0, 6.0, 2.0).collect()
    assert {r["z"] for r in out} == {3.0} and len({(r["row"], r["col"]) for r in out}) == len(out) == 144


def test_predictors_get_bounded_blocks(spark):
    p = cloud(spark, [(0, 0, 0), (0, 0, 9), (3, 3, 2)])
    got = values(predict.component_filter(p, lambda: predict.HeightRule(5.0, 1.0), (1.0, 1.0, 1.0), (10, 10, 10)), "pid", "label")
    assert got == [(0, 1), (1, 2), (2, 1)]
    import pandas as pd

    dense = predict.dense_block(pd.DataFrame({"i": [0], "j": [1], "k": [2], "v": [7.0]}), (2, 2, 3), "v")
    assert dense[0, 1, 2] == 7 and dense.sum() == 7
    assert predict.softmax(np.array([0.0, 0.0])).tolist() == [0.5, 0.5]


def test_las_round_trip(spark, tmp_path):
    p = cloud(spark, [(1.25, 2, 3), (100.5, -2, 3.5)], cls=("int", [2, 6]))
    las.write_las(p, f"{tmp_path}/las", "cls")
    assert values(las.read_las(spark, f"{tmp_path}/las"), "pid", "x", "y", "z", "classification", "label") == [(0, 1.25, 2.0, 3.0, 2, 2), (1, 100.5, -2.0, 3.5, 6, 6)]
    las.write_las(p.withColumn("cls", F.col("cls") + 300), f"{tmp_path}/wide", "cls")
    assert values(las.read_las(spark, f"{tmp_path}/wide"), "pid", "z", "classification", "label") == [(0, 3.0, 0, 302), (1, 3.5, 0, 306)]
    las.write_las(p, f"{tmp_path}/plain")
    assert values(las.read_las(spark, f"{tmp_path}/plain"), "pid", "z", "label") == [(0, 3.0, None), (1, 3.5, None)]
    with pytest.raises(ValueError):
        las.header(b"nothing of the kind" * 20)


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2  3\n1\t2 3\n\n 4 5 6 \n")
    assert values(text.read_xyz_text(spark, str(tmp_path / "a.txt")), "x", "y", "z") == [(1, 2, 3), (4, 5, 6)]


def test_models():
    c = models.parse_config('{"model": {"voxel_number_in_block": [1, 2, 3], "voxel_resolution_in_meter": [0.1, 0.2, 0.3]}}')
    assert c.num_classes == 2 and c.with_resolution((1, 1, 1)).resolution == (1, 1, 1) and c.with_resolution((1, 0, 1)).resolution == (0.1, 0.2, 0.3)
    for bad in ("{", "[]", '{"model": {}}'):
        with pytest.raises(ValueError):
            models.parse_config(bad)


def test_scalars(spark):
    r = spark.range(1).select(F.round(scalar.sigmoid(F.lit(0.0)), 3).alias("s"), scalar.relu(F.lit(-1.0)).alias("r"), scalar.interp(F.lit(5.0), [0.0, 10.0], [0.0, 1.0]).alias("i")).first()
    assert tuple(r) == (0.5, 0.0, 0.5)


def test_streamed_tiles(spark, tmp_path):
    p = cloud(spark, [(0.2, 0.2, 5), (0.4, 0.1, 3), (7, 7, 1)])
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = foreach_cloud(stream, lambda b: aggregates.cell_min(grid.raster_key_lowerleft(b, 1.0)), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "value") == [(1.0,), (3.0,)]
    assert running_cell_min(stream, 1.0).isStreaming


def _proto(*fields):
    """A protocol buffer message from (number, value): integers, strings, or messages as bytes."""
    out = b""
    for number, value in fields:
        value = value.encode() if isinstance(value, str) else value
        if isinstance(value, int):
            out += bytes([number << 3 & 127 | (128 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        else:
            out += bytes([number << 3 | 2, *([len(value)] if len(value) < 128 else [len(value) & 127 | 128, len(value) >> 7])]) + value
    return out


def test_onnx_predictor(spark, tmp_path):
    """A network of two channels, minus and plus occupancy, through the factory."""

    def value(name, *shape):
        dims = _proto(*((1, _proto((1, n))) for n in shape))
        return _proto((1, name), (2, _proto((1, _proto((1, 1), (2, dims))))))

    nodes = [_proto((1, "x"), (2, "m"), (4, "Neg")), _proto((1, "m"), (1, "x"), (2, "y"), (4, "Concat"), (5, _proto((1, "axis"), (3, 1), (20, 2))))]
    graph = _proto(*((1, n) for n in nodes), (2, "g"), (11, value("x", 1, 1, 4, 4, 4)), (12, value("y", 1, 2, 4, 4, 4)))
    (tmp_path / "net.onnx").write_bytes(_proto((1, 8), (7, graph), (8, _proto((2, 13)))))
    weights = models.load_weights(spark, f"file://{tmp_path}/net.onnx")
    with pytest.raises(ValueError):
        models.load_weights(spark, f"file://{tmp_path}/net.onnx", 10)
    p = cloud(spark, [(0.5 * i, 0.5 * i, 0.5 * i) for i in range(6)])
    got = values(predict.component_filter(p, predict.onnx_factory(spark, weights, (4, 4, 4)), (1.0, 1.0, 1.0), (4, 4, 4)), "pid", "label")
    assert got == [(i, 2) for i in range(6)]
    model = predict.OnnxModel(weights, (4, 4, 4), ("low", "high"))
    out = model(pd.DataFrame({"i": [0, 1], "j": [2, 3], "k": [3, 0]}))
    assert out["low"].tolist() == [-1.0, -1.0] and out["high"].tolist() == [1.0, 1.0]
