"""One query per operator over the derived clouds, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.functions import scalar
from pointspark.operators import aggregates as agg
from pointspark.operators import filters, graph, grid, predict, qsm, ranking, raster, segment, sets, spatial, superpoints
from pointspark.shared import materialize, shared_path
from pointspark.sources import las, mesh, models, text
from pointspark.sources.points import POINTS_SQL, TREELOC_SQL, child_cloud, emit_cloud, field_range, points, scan_field, scan_points, tree_locations, upsert_field

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

CTES = f"points AS ({POINTS_SQL}), treeloc AS ({TREELOC_SQL})"


def _add(name: str, query: Query, sql: str | None = None, recursive: bool = False) -> None:
    _queries[name] = query
    if sql:
        sql = sql.strip()
        head = f"WITH {'RECURSIVE ' if recursive else ''}{CTES}"
        _sql[name] = f"{head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head} {sql}"


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def cell(expr: str, size: float) -> str:
    return f"CAST(floor(({expr}) / CAST({size!r} AS DOUBLE)) AS BIGINT)"


def on_points(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(points(spark, d))


def on_locations(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(tree_locations(spark, d))


def on_both(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(points(spark, d), tree_locations(spark, d))


EXT = "ext AS (SELECT cloud_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY 1)"

# ---------------------------------------------------------------- sources and sinks


def _stored(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "cloud")
    points(spark, d).write.parquet(path)
    return scan_points(spark, path).select("cloud_id", "pid", "x", "y", "z", "treefilter")


_add("scan_points", _stored, "SELECT cloud_id, pid, x, y, z, treefilter FROM points")
_add("scan_field", on_points(lambda p: scan_field(p, "conf")), "SELECT cloud_id, pid, conf FROM points")
_add(
    "upsert_field",
    on_points(lambda p: upsert_field(p, p.filter("stemcls > 1").select("cloud_id", "pid", F.round(F.col("conf") * 2, 6).alias("conf")), "conf", 0.0).select("pid", "conf")),
    "SELECT pid, CASE WHEN stemcls > 1 THEN round(conf * 2, 6) ELSE CAST(0 AS DOUBLE) END AS conf FROM points",
)
_add("field_range", on_points(lambda p: field_range(p, "conf")), "SELECT cloud_id, min(conf) AS min_value, max(conf) AS max_value FROM points GROUP BY 1")
_add("child_cloud", on_both(lambda p, t: child_cloud(p, t)), "SELECT * FROM treeloc")


def _emitted(spark: SparkSession, d: str) -> DataFrame:
    path = emit_cloud(tree_locations(spark, d).select("cloud_id", "loc_id", "x", "y", "z"), shared_path(spark, "emitted"), "loc")
    return spark.read.parquet(path).select("cloud_id", "loc_id", "x", "y", "z")


_add("emit_cloud", _emitted, "SELECT 'c0_loc' AS cloud_id, loc_id, x, y, z FROM treeloc")


def _tree_paths(p: DataFrame) -> DataFrame:
    """Each tree's points from low to high as one path."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("cloud_id", "itc").orderBy("z", "pid")) - 1
    return p.select("cloud_id", F.col("itc").cast("int").alias("path_id"), seq.cast("int").alias("seq"), F.col("pid").alias("node_id"), "x", "y", "z", "radius")


SQL_PATHS = "paths AS (SELECT cloud_id, CAST(itc AS INT) AS path_id, CAST(row_number() OVER (PARTITION BY itc ORDER BY z, pid) - 1 AS INT) AS seq, pid AS node_id, x, y, z, radius FROM points)"
_add(
    "emit_polylines",
    on_points(lambda p: qsm.emit_polylines(_tree_paths(p)).select("path_id", "name", F.posexplode("vertices").alias("at", "v")).select("path_id", "name", "at", "v.x", "v.y", "v.z")),
    f"WITH {SQL_PATHS} SELECT path_id, CASE WHEN path_id = 0 THEN 'Stem' ELSE 'Branch_' || path_id END AS name, seq AS at, x, y, z FROM paths",
)


def _las(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "las")
    las.write_las(points(spark, d).withColumn("label", F.col("itc") + 300), path, "label", points_per_file=1 << 40)
    return las.read_las(spark, path).select("pid", *r6("x", "y", "z"), "classification", "label")


_add("write_read_las", _las, "SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, x, y, z, CAST(itc + 300 AS INT) AS label, 0::INT AS classification FROM points")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "xyz")
    text.write_text(points(spark, d).select("x", "y", "z"), path)
    return text.read_xyz_text(spark, path)


_add("write_read_xyz_text", _texts, "SELECT DISTINCT x, y, z FROM points")

INVENTORY = f"""
  frame AS (SELECT cloud_id, min(x) AS xmin, max(y) AS ymax, max(x) AS xmax, min(y) AS ymin FROM points GROUP BY 1),
  keyed AS (SELECT p.cloud_id, CAST(floor((ymax - y) / 2.0::DOUBLE) AS BIGINT) AS i, {cell("x - xmin", 2.0)} AS j, z, xmin, ymax,
    ceil((ymax - ymin) / 2.0::DOUBLE) AS ni, ceil((xmax - xmin) / 2.0::DOUBLE) AS nj FROM points p JOIN frame f USING (cloud_id) WHERE treefilter <= 1),
  ground AS (SELECT cloud_id, i, j, min(z) AS gz, any_value(xmin) AS xmin, any_value(ymax) AS ymax FROM keyed WHERE i < ni AND j < nj GROUP BY 1, 2, 3),
  cells AS (SELECT *, xmin + (j + 0.5::DOUBLE) * 2.0::DOUBLE AS cx, ymax - (i + 0.5::DOUBLE) * 2.0::DOUBLE AS cy, row_number() OVER (PARTITION BY cloud_id ORDER BY i, j) AS id FROM ground),
  veg AS (SELECT p.pid, p.itc, p.x, p.y, p.z, arg_min(c.gz, ((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy), c.id)) AS gz
    FROM points p JOIN cells c USING (cloud_id) WHERE treefilter > 1 GROUP BY 1, 2, 3, 4, 5),
  trees AS (SELECT itc, avg(x) AS x, avg(y) AS y, max(z) AS z, max(z) - (min(z) + min(gz)) * 0.5::DOUBLE AS height, count(*) AS n FROM veg GROUP BY 1)"""


def _sql_hull(table: str, label: str = "itc", least: int = 7) -> str:
    """CTE ``hull(label, area)``: from the lowest point of each group always to the point least to the left."""
    turn = f"round(fmod(atan2(b.y - h.y, b.x - h.x) - h.dir + 4 * pi(), 2 * pi()), 9)"
    return f"""corner AS (SELECT {label} AS label, arg_min(x, (y, x)) AS x, min(y) AS y, count(*) AS n FROM {table} GROUP BY 1),
    ring(label, k, x0, y0, x, y, dir) AS (SELECT label, 0, x, y, x, y, 0::DOUBLE FROM corner
      UNION ALL SELECT label, k, x0, y0, nx, ny, atan2(ny - y, nx - x) FROM (SELECT h.label, h.k + 1 AS k, x0, y0, h.x, h.y, arg_min(b.x, (fmod({turn}, round(2 * pi(), 9)), -((b.x - h.x) * (b.x - h.x) + (b.y - h.y) * (b.y - h.y)))) AS nx, arg_min(b.y, (fmod({turn}, round(2 * pi(), 9)), -((b.x - h.x) * (b.x - h.x) + (b.y - h.y) * (b.y - h.y)))) AS ny
        FROM ring h JOIN {table} b ON b.{label} = h.label AND (b.x <> h.x OR b.y <> h.y) WHERE h.k = 0 OR h.x <> h.x0 OR h.y <> h.y0 GROUP BY h.label, h.k, x0, y0, h.x, h.y, h.dir)),
    hull AS (SELECT c.label, CASE WHEN any_value(n) >= {least} THEN coalesce(abs(sum(r.x * r.ny - r.nx * r.y)) / 2, 0) ELSE 0 END AS area FROM corner c LEFT JOIN (SELECT label, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ring WINDOW w AS (PARTITION BY label ORDER BY k)) r ON r.label = c.label AND r.nx IS NOT NULL GROUP BY 1)"""


_add(
    "tree_inventory",
    on_points(lambda p: segment.tree_inventory(p, area=True).select("itc", *r6("x", "y", "z", "height"), "n", *r6("area"))),
    f"WITH {INVENTORY}, {_sql_hull('veg')} SELECT itc, {q6('x', 'y', 'z', 'height')}, n, {q6('area')} FROM trees JOIN hull ON label = itc",
    recursive=True,
)


def _treestat(spark: SparkSession, d: str) -> DataFrame:
    stats = segment.tree_inventory(points(spark, d), area=True).withColumnRenamed("area", "crown_area")
    path = shared_path(spark, "treestat")
    rounded = stats.withColumns({c: F.round(c, 6) for c in ("x", "y", "z", "height", "crown_area")})
    text.write_treestat(rounded, path)
    return spark.read.csv(path, sep=" ", header=True, schema="itc_id long, x double, y double, z double, height double, crown_area double")


def q3(*names: str) -> str:
    """As ``%.3f`` writes them, read again."""
    return ", ".join(f"CAST(round(CAST(round({n}, 6) AS DECIMAL(18, 6)), 3) AS DOUBLE) AS {n}" for n in names)


_add("write_treestat", _treestat, f"WITH {INVENTORY}, {_sql_hull('veg')}, t AS (SELECT itc, x, y, z, height, area AS crown_area FROM trees JOIN hull ON label = itc) SELECT itc AS itc_id, {q3('x', 'y', 'z', 'height', 'crown_area')} FROM t", recursive=True)


def _skeleton(spark: SparkSession, d: str) -> DataFrame:
    """Ten heights of each tree as a stem of its own cloud."""
    p = points(spark, d)
    rows = p.groupBy(F.concat(F.lit("t"), "itc").alias("cloud_id"), F.floor(F.col("z") / 3).cast("int").alias("seq")).agg(*[F.avg(c).alias(c) for c in "xyz"], F.avg("radius").alias("radius"))
    return rows.select("cloud_id", F.lit(0).alias("path_id"), "seq", F.col("seq").cast("long").alias("node_id"), "x", "y", "z", "radius")


def _obj(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "obj")
    mesh.write_obj(_skeleton(spark, d), path, interval=1.0)
    vertices, faces = mesh.read_obj(spark, path)
    corners = faces.select(F.lit("f").alias("kind"), *[F.col(f"v{i}").cast("double").alias(f"a{i}") for i in range(1, 5)])
    return vertices.select(F.lit("v").alias("kind"), *r6("x", "y", "z"), F.lit(None).cast("double").alias("a4")).toDF(*corners.columns).unionByName(corners)


_add("write_read_obj", _obj)


def _xml(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "xml")
    mesh.write_xml(_skeleton(spark, d), path)
    return spark.read.text(path).select(F.trim("value").alias("line"))


_add("write_xml", _xml)

CONFIG = '{"title": "t", "model": {"type": "seg", "voxel_number_in_block": [128, 128, 128], "voxel_resolution_in_meter": [0.5, 0.5, 0.8], "patch_size": 4}}'


def _config(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "config")
    spark.createDataFrame([(CONFIG,)], "value string").coalesce(1).write.text(path)
    c = models.read_config(spark, path)
    return spark.createDataFrame([(c.title, c.kind, c.num_classes, *c.size, *c.resolution)], "title string, kind string, num_classes int, nx int, ny int, nz int, rx double, ry double, rz double")


_add("read_config", _config, "SELECT 't' AS title, 'seg' AS kind, 2 AS num_classes, 128 AS nx, 128 AS ny, 128 AS nz, 0.5::DOUBLE AS rx, 0.5::DOUBLE AS ry, 0.8::DOUBLE AS rz")
MODELS = ["filter_als_esegformer3D_128_50cm(GPU3GB)", "filter_uav_segformer3D_112_12.5cm(GPU8GB)"]
_add(
    "model_catalog",
    lambda spark, d: models.model_catalog(spark, MODELS, {MODELS[0]}, "base/"),
    "SELECT * FROM (VALUES "
    f"('{MODELS[0]}', true, 50::DOUBLE, 128::INT, true, 'base/filter_als_esegformer3D_128_50cm_GPU3GB'), "
    f"('{MODELS[1]}', false, 12.5::DOUBLE, 112::INT, false, 'base/filter_uav_segformer3D_112_12.5cm_GPU8GB')) t(name, downloaded, resolution_cm, block, efficient, url)",
)

# ---------------------------------------------------------------- predicates and projections

_add(
    "shift_to_origin",
    on_points(lambda p: filters.shift_to_origin(p.select("cloud_id", "pid", "x", "y", "z")).select("pid", *r6("x", "y", "z"))),
    f"WITH {EXT} SELECT pid, round(x - x0, 6) AS x, round(y - y0, 6) AS y, round(z - z0, 6) AS z FROM points JOIN ext USING (cloud_id)",
)
for _name, _f, _where in (
    ("filter_above_ground", filters.filter_above_ground, "treefilter > 1"),
    ("filter_ground", filters.filter_ground, "treefilter <= 1"),
    ("filter_stem", filters.filter_stem, "stemcls > 1"),
    ("filter_branch", filters.filter_branch, "branchcls > 1"),
    ("filter_confidence", filters.filter_confidence, "conf > 0.5"),
):
    _add(_name, on_points(lambda p, f=_f: f(p).select("pid", "x", "y", "z")), f"SELECT pid, x, y, z FROM points WHERE {_where}")
_add(
    "filter_min_radius",
    on_points(lambda p: filters.filter_min_radius(agg.component_median(p, "radius", "itc"), 0.4).select("itc", *r6("radius"))),
    "SELECT itc, round(median(radius), 6) AS radius FROM points GROUP BY 1 HAVING median(radius) > 0.4",
)
_add(
    "scatter_back",
    on_points(lambda p: filters.scatter_back(p.select("cloud_id", "pid"), p.filter("treefilter > 1").select("cloud_id", "pid", "itc"), "itc").select("pid", "itc")),
    "SELECT pid, CASE WHEN treefilter > 1 THEN itc ELSE 0 END AS itc FROM points",
)
_add(
    "tile_height_cut",
    on_points(lambda p: filters.tile_height_cut(p, 0.4).select("pid", "z")),
    f"""WITH {EXT}, t AS (SELECT pid, z, {cell("x - x0", 5.0)} AS i, {cell("y - y0", 5.0)} AS j FROM points JOIN ext USING (cloud_id)),
    s AS (SELECT i, j, min(z) AS lo, max(z) AS hi FROM t GROUP BY 1, 2) SELECT pid, z FROM t JOIN s USING (i, j) WHERE z - lo <= (hi - lo) * 0.4::DOUBLE""",
)
_add(
    "drop_non_finite",
    on_points(lambda p: filters.drop_non_finite(p.withColumn("z", F.when(F.col("itc") == 1, F.lit(float("nan"))).when(F.col("itc") == 2, F.lit(float("inf"))).otherwise(F.col("z")))).select("pid", "z")),
    "SELECT pid, z FROM points WHERE itc NOT IN (1, 2)",
)
SIDES = (20.0, 20.0, 20.0)
RES, SIZE = (0.5, 0.5, 0.5), (40, 40, 40)


def _sql_blocks(sides: tuple[float, ...], overlap: float = 0.1) -> str:
    """CTE ``blocks(pid, x, y, z, ..., block_id)``, by the definition: every block of an axis that holds the point."""
    ctes, names = [EXT], []
    for a, s in zip("xyz", sides, strict=False):
        stride = s * (1 - overlap)
        n = f"CAST(greatest(floor(({a}1 - {a}0 - {s!r}::DOUBLE) / {stride!r}::DOUBLE) + 2, 1) AS BIGINT)"
        ctes.append(f"ax{a} AS (SELECT cloud_id, n AS n{a}, i AS i{a}, {a}0 + i * {stride!r}::DOUBLE AS s{a} FROM (SELECT cloud_id, {a}0, n, unnest(range(n)) AS i FROM (SELECT cloud_id, {a}0, {n} AS n FROM ext)))")
        names.append(a)
    ident = "0"
    for a in names:
        ident = f"({ident} * n{a} + i{a})"
    joins = " ".join(f"JOIN ax{a} ON ax{a}.cloud_id = p.cloud_id AND p.{a} >= s{a} AND p.{a} < s{a} + {s!r}::DOUBLE" for a, s in zip(names, sides, strict=True))
    ctes.append(f"blocks AS (SELECT p.*, CAST({ident} AS BIGINT) AS block_id FROM points p {joins})")
    return ", ".join(ctes)


def _sql_voxels(res=RES, size=SIZE) -> str:
    """CTEs ``low`` and ``vox`` over ``blocks``."""
    ijk = ", ".join(f"{cell(f'{a} - l{a}', r)} AS {o}" for a, r, o in zip("xyz", res, "ijk", strict=True))
    inside = " AND ".join(f"{o} >= 0 AND {o} < {n}" for o, n in zip("ijk", size, strict=True))
    return f"""low AS (SELECT block_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM blocks GROUP BY 1),
    vox AS (SELECT *, i * {size[1] * size[2]} + j * {size[2]} + k AS voxel FROM (SELECT b.*, {ijk} FROM blocks b JOIN low USING (block_id)) WHERE {inside})"""


_add(
    "in_block_bounds",
    on_points(lambda p: filters.in_block_bounds(grid.voxel_key(p, 2.0), (30, 20, 10)).select("pid", "i", "j", "k")),
    f"SELECT * FROM (SELECT pid, {cell('x', 2.0)} AS i, {cell('y', 2.0)} AS j, {cell('z', 2.0)} AS k FROM points) WHERE i >= 0 AND i < 30 AND j >= 0 AND j < 20 AND k >= 0 AND k < 10",
)


def _grid_block_points(p: DataFrame) -> DataFrame:
    return grid.grid_blocks(p, RES[:2], SIZE[:2]).withColumn("block_id", F.col("bi") * 1000 + F.col("bj"))


SQL_GRID_BLOCKS = f"{EXT}, blocks AS (SELECT p.*, CAST(floor((x - x0) / 0.5::DOUBLE / 40) * 1000 + floor((y - y0) / 0.5::DOUBLE / 40) AS BIGINT) AS block_id FROM points p JOIN ext USING (cloud_id))"
_add(
    "loc_in_tile",
    on_both(lambda p, t: filters.loc_in_tile(_grid_block_points(p), t).select("block_id", "loc_id")),
    f"""WITH {SQL_GRID_BLOCKS}, box AS (SELECT block_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM blocks GROUP BY 1)
    SELECT block_id, loc_id FROM treeloc JOIN box ON x > a AND x < b AND y > c AND y < d AND z > e AND z < f""",
)
_add("append_columns", on_points(lambda p: p.select("x", "y", "z", "stemcls", "itc")), "SELECT x, y, z, stemcls, itc FROM points")
_add("normalize_class", on_points(lambda p: filters.filter_branch(filters.normalize_class(p)).select("pid", "stemcls")), "SELECT pid, stemcls - (SELECT min(stemcls) FROM points) AS stemcls FROM points WHERE branchcls > 1")
_add(
    "compact_labels",
    on_points(lambda p: filters.compact_labels(p.select("cloud_id", "pid", (F.col("itc") * 7 + 3).alias("label"))).select("pid", "label")),
    "SELECT pid, dense_rank() OVER (ORDER BY itc * 7 + 3) - 1 AS label FROM points",
)
_add("guard_block_count", on_points(lambda p: filters.block_count(filters.guard_block_count(p, 50, 40), 50, 40)), f"WITH {EXT} SELECT cloud_id, CAST(floor((x1 - x0) / 20.0::DOUBLE) * floor((y1 - y0) / 20.0::DOUBLE) AS BIGINT) AS n_blocks FROM ext")
_add("guard_min_points", on_points(lambda p: filters.point_count(filters.guard_min_points(p, 100))), "SELECT cloud_id, count(*) AS n_points FROM points GROUP BY 1")
_add(
    "apply_offsets",
    on_points(lambda p: filters.apply_offsets(p.withColumns({"dx": F.col("conf") - 0.5, "dy": F.col("radius")}), (0.1, 0.2)).select("pid", *r6("x", "y"))),
    "SELECT pid, round(x + (conf - 0.5::DOUBLE) * 0.1::DOUBLE, 6) AS x, round(y + radius * 0.2::DOUBLE, 6) AS y FROM points",
)
_add("preserve_existing", on_points(lambda p: filters.preserve_existing(p.withColumn("pred", F.col("itc")), "stemoff").select("pid", "pred")), "SELECT pid, CASE WHEN stemoff > 0 THEN stemoff ELSE itc END AS pred FROM points")
_add(
    "noise_relabel",
    on_points(lambda p: filters.noise_relabel(p.withColumn("component", F.pmod("itc", F.lit(3)))).select("pid", "stemcls")),
    "SELECT pid, CASE WHEN stemcls > 1 AND itc % 3 > 0 THEN 2 ELSE 1 END AS stemcls FROM points",
)

# ---------------------------------------------------------------- tiles, voxels, raster keys

_add("sliding_blocks", on_points(lambda p: grid.sliding_blocks(p, SIDES).select("pid", "block_id")), f"WITH {_sql_blocks(SIDES)} SELECT pid, block_id FROM blocks")
_add("sliding_blocks_flat", on_points(lambda p: grid.sliding_blocks(p, SIDES[:2]).select("pid", "block_id")), f"WITH {_sql_blocks(SIDES[:2])} SELECT pid, block_id FROM blocks")
_add(
    "grid_blocks",
    on_points(lambda p: grid.grid_blocks(p, RES[:2], SIZE[:2]).select("pid", "bi", "bj")),
    f"WITH {EXT} SELECT pid, CAST(floor((x - x0) / 0.5::DOUBLE / 40) AS BIGINT) AS bi, CAST(floor((y - y0) / 0.5::DOUBLE / 40) AS BIGINT) AS bj FROM points JOIN ext USING (cloud_id)",
)
_add("coarse_tiles", on_points(lambda p: grid.coarse_tiles(p).select("pid", "bi", "bj")), f"WITH {EXT} SELECT pid, {cell('x - x0', 5.0)} AS bi, {cell('y - y0', 5.0)} AS bj FROM points JOIN ext USING (cloud_id)")
_add(
    "buffered_tiles",
    on_points(lambda p: grid.buffered_tiles(p, 20.0, 2.0).select("pid", "ti", "tj")),
    f"""WITH {EXT}, a AS (SELECT cloud_id, x0, unnest(range(CAST(ceil((x1 - x0) / 20.0::DOUBLE) AS BIGINT))) AS ti FROM ext), b AS (SELECT cloud_id, y0, unnest(range(CAST(ceil((y1 - y0) / 20.0::DOUBLE) AS BIGINT))) AS tj FROM ext)
    SELECT pid, ti, tj FROM points p JOIN a ON x - x0 >= ti * 20.0::DOUBLE - 2.0::DOUBLE AND x - x0 <= (ti + 1) * 20.0::DOUBLE + 2.0::DOUBLE JOIN b ON y - y0 >= tj * 20.0::DOUBLE - 2.0::DOUBLE AND y - y0 <= (tj + 1) * 20.0::DOUBLE + 2.0::DOUBLE""",
)
_add(
    "block_voxelize",
    on_points(lambda p: grid.voxels(grid.block_voxelize(grid.sliding_blocks(p, SIDES), RES, SIZE)).select("block_id", "voxel", "i", "j", "k", "n")),
    f"WITH {_sql_blocks(SIDES)}, {_sql_voxels()} SELECT block_id, voxel, i, j, k, count(*) AS n FROM vox GROUP BY ALL",
)
_add(
    "decimate",
    on_points(lambda p: grid.decimate(p, 0.6)[0].select("pid", "x", "y", "z")),
    f"SELECT min(pid) AS pid, arg_min(x, pid) AS x, arg_min(y, pid) AS y, arg_min(z, pid) AS z FROM points GROUP BY {cell('x', 0.6)}, {cell('y', 0.6)}, {cell('z', 0.6)}",
)
_add(
    "decimate_inverse",
    on_points(lambda p: grid.decimate(p, 2.0)[1].select("pid", "rep")),
    f"SELECT pid, min(pid) OVER (PARTITION BY {cell('x', 2.0)}, {cell('y', 2.0)}, {cell('z', 2.0)}) AS rep FROM points",
)
_add(
    "voxel_unique_origin",
    on_points(lambda p: grid.voxel_key(p, 0.2, "min").groupBy("i", "j", "k").agg(F.count("*").alias("n"))),
    f"WITH {EXT} SELECT {cell('x - x0', 0.2)} AS i, {cell('y - y0', 0.2)} AS j, {cell('z - z0', 0.2)} AS k, count(*) AS n FROM points JOIN ext USING (cloud_id) GROUP BY 1, 2, 3",
)
_add(
    "decimate_ymax",
    on_points(lambda p: grid.decimate(p, 1.0, "ymax")[0].select("pid")),
    f"WITH {EXT} SELECT min(pid) AS pid FROM points JOIN ext USING (cloud_id) GROUP BY {cell('y1 - y', 1.0)}, {cell('x - x0', 1.0)}, {cell('z - z0', 1.0)}",
)
_add("raster_key_lowerleft", on_points(lambda p: grid.raster_key_lowerleft(p, 2.0).select("pid", "row", "col")), f"WITH {EXT} SELECT pid, {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col FROM points JOIN ext USING (cloud_id)")
SQL_UPPER = f"keyed AS (SELECT p.*, {cell('y1 - y', 2.0)} AS row, {cell('x - x0', 2.0)} AS col, x0 AS xmin, y1 AS ymax, ceil((y1 - y0) / 2.0::DOUBLE) AS nr, ceil((x1 - x0) / 2.0::DOUBLE) AS nc FROM points p JOIN ext USING (cloud_id))"
_add("raster_key_upperleft", on_points(lambda p: grid.raster_key_upperleft(p, 2.0).select("pid", "row", "col")), f"WITH {EXT}, {SQL_UPPER} SELECT pid, row, col FROM keyed WHERE row < nr AND col < nc")


def _patches(p: DataFrame) -> DataFrame:
    return grid.voxel_key(grid.sliding_blocks(p, SIDES[:2]), 1.0).groupBy("cloud_id", "block_id", "i", "j").agg(F.max("z").alias("value"))


SQL_PATCHES = f"{_sql_blocks(SIDES[:2])}, patches AS (SELECT block_id, {cell('x', 1.0)} AS i, {cell('y', 1.0)} AS j, max(z) AS value FROM blocks GROUP BY 1, 2, 3)"
_add("mosaic_patches", on_points(lambda p: grid.mosaic_patches(_patches(p)).select("i", "j", "value")), f"WITH {SQL_PATCHES} SELECT i, j, arg_max(value, block_id) AS value FROM patches GROUP BY 1, 2")
_add("union_patches", on_points(lambda p: sets.union_patches(*[_patches(p).filter(F.pmod("block_id", F.lit(2)) == m) for m in (0, 1)]).select("block_id", "i", "j", "value")), f"WITH {SQL_PATCHES} SELECT block_id, i, j, value FROM patches")


def _upper_cells(p: DataFrame) -> DataFrame:
    keyed = grid.raster_key_upperleft(p, 2.0)
    return agg.cell_min(keyed, by=("cloud_id", "row", "col", "xmin", "ymax"))


_add(
    "raster_to_points",
    on_points(lambda p: grid.raster_to_points(_upper_cells(p), 2.0, True).select(*r6("x", "y", "z"))),
    f"WITH {EXT}, {SQL_UPPER} SELECT round(xmin + (col + 0.5::DOUBLE) * 2.0::DOUBLE, 6) AS x, round(ymax - (row + 0.5::DOUBLE) * 2.0::DOUBLE, 6) AS y, round(min(z), 6) AS z FROM keyed WHERE row < nr AND col < nc GROUP BY xmin, ymax, row, col",
)
_add(
    "tile_merge_mean",
    on_points(lambda p: grid.tile_merge_mean(grid.raster_key_lowerleft(p, 2.0).withColumn("seq", F.col("pid"))).select("row", "col", "x", "y", *r6("z"))),
    f"WITH {EXT} SELECT {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col, arg_min(x, pid) AS x, arg_min(y, pid) AS y, round(avg(z), 6) AS z FROM points JOIN ext USING (cloud_id) GROUP BY 1, 2",
)

# ---------------------------------------------------------------- neighbour joins

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"
D2XY = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"


def _sql_bounded(table: str, ident: str, k: int, bound: float) -> str:
    """CTE ``near(src, dst, dist, rank)`` by adjacent cells of the bound's width."""
    c = ", ".join(f"CAST(floor({a} / {bound!r}::DOUBLE) AS BIGINT) AS g{a}" for a in "xyz")
    return f"""g AS (SELECT {ident} AS id, x, y, z, {c} FROM {table}), o AS (SELECT unnest([-1, 0, 1]) AS o),
    near AS (SELECT * FROM (SELECT src, dst, sqrt(d2) AS dist, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM
      (SELECT a.id AS src, b.id AS dst, {D2} AS d2 FROM (SELECT g.*, gx + ox.o AS hx, gy + oy.o AS hy, gz + oz.o AS hz FROM g, o ox, o oy, o oz) a JOIN g b ON b.gx = hx AND b.gy = hy AND b.gz = hz AND a.id <> b.id)
      WHERE d2 < {bound!r}::DOUBLE * {bound!r}::DOUBLE) WHERE rank <= {k})"""


_add("knn_bounded", on_points(lambda p: spatial.knn_bounded(p, 4, 3.0).select("src", "dst", *r6("dist"), "rank")), f"WITH {_sql_bounded('points', 'pid', 4, 3.0)} SELECT src, dst, {q6('dist')}, CAST(rank AS INT) AS rank FROM near")


def _sql_knn(left: str, lid: str, right: str, rid: str, k: int, d2: str, same: bool) -> str:
    return f"""near AS (SELECT * FROM (SELECT a.{lid} AS src, b.{rid} AS dst, sqrt({d2}) AS dist, row_number() OVER (PARTITION BY a.{lid} ORDER BY {d2}, b.{rid}) AS rank
      FROM {left} a JOIN {right} b ON a.cloud_id = b.cloud_id {f"AND a.{lid} <> b.{rid}" if same else ""}) WHERE rank <= {k})"""


_add("knn_unbounded", on_locations(lambda t: spatial.knn(t, 4, left_id="loc_id", right_id="loc_id").select("src", "dst", *r6("dist"), "rank")), f"WITH {_sql_knn('treeloc', 'loc_id', 'treeloc', 'loc_id', 4, D2, True)} SELECT src, dst, {q6('dist')}, CAST(rank AS INT) AS rank FROM near")


def _sql_nn(d2: str) -> str:
    return f"""near AS (SELECT src, dst, sqrt(d2) AS dist FROM (SELECT a.pid AS src, arg_min(b.loc_id, ({d2}, b.loc_id)) AS dst, min({d2}) AS d2 FROM points a JOIN treeloc b USING (cloud_id) GROUP BY 1))"""


_add("nn_xy", on_both(lambda p, t: spatial.nn_xy(p, t).select("src", "dst", *r6("dist"))), f"WITH {_sql_nn(D2XY)} SELECT src, dst, {q6('dist')} FROM near")
_add("nn_xyz", on_both(lambda p, t: spatial.nn_xyz(p, t, "loc_id").select("src", "dst", *r6("dist"))), f"WITH {_sql_nn(D2)} SELECT src, dst, {q6('dist')} FROM near")
_add(
    "ball_lowest",
    on_both(lambda p, t: spatial.ball_lowest(t, p, 2.0, "loc_id").select("loc_id", "x", "y", "z")),
    f"SELECT b.loc_id, arg_min(a.x, (a.z, a.pid)) AS x, arg_min(a.y, (a.z, a.pid)) AS y, min(a.z) AS z FROM points a JOIN treeloc b ON {D2XY} <= 4.0::DOUBLE GROUP BY 1",
)


def _labelled(p: DataFrame, size: float = 5.0) -> DataFrame:
    """Points with ``label``: the number of their ``size`` m voxel."""
    return p.withColumn("label", F.floor(F.col("x") / size) * 10000 + F.floor(F.col("y") / size) * 100 + F.floor(F.col("z") / size))


LABELLED = f"lab AS (SELECT *, {cell('x', 5.0)} * 10000 + {cell('y', 5.0)} * 100 + {cell('z', 5.0)} AS label FROM points)"
CENTRES = "cen AS (SELECT cloud_id, label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lab GROUP BY 1, 2)"


def _near_clusters(p: DataFrame, k: int, axes: str) -> DataFrame:
    centres = agg.component_centroid(p).withColumnRenamed("label", "pid").withColumns({c: F.round(c, 6) for c in "xyz"})
    return spatial.knn(materialize(centres, "centres"), k, axes)


CENTRES6 = f"cen AS (SELECT cloud_id, label, {q6('x', 'y', 'z')} FROM (SELECT cloud_id, label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM lab GROUP BY 1, 2))"
CLOSEST = f"""best AS (SELECT src, dst, sqrt(min(q3)) AS d3, sqrt(arg_min(q2, (q3, lid, rid))) AS d2 FROM (SELECT n.src, n.dst, a.pid AS lid, b.pid AS rid, {D2} AS q3, {D2XY} AS q2
    FROM near n JOIN lab a ON a.label = n.src JOIN lab b ON b.label = n.dst) GROUP BY 1, 2)"""
_add(
    "cluster_min_distance",
    on_points(lambda p: spatial.cluster_min_distance(_labelled(p), _near_clusters(_labelled(p), 4, "xy")).select("src", "dst", *r6("d3", "d2"))),
    f"WITH {LABELLED}, {CENTRES6}, {_sql_knn('cen', 'label', 'cen', 'label', 4, D2XY, True)}, {CLOSEST} SELECT src, dst, {q6('d3', 'd2')} FROM best",
)


def _touching(p: DataFrame) -> DataFrame:
    return graph.touching_segments(p, 4, 3.0, "itc")


TOUCHING = f"{_sql_bounded('points', 'pid', 4, 3.0)}, touching AS (SELECT DISTINCT a.itc AS src, b.itc AS dst FROM near n JOIN points a ON a.pid = n.src JOIN points b ON b.pid = n.dst WHERE a.itc <> b.itc)"


def _all_pairs(p: DataFrame) -> DataFrame:
    """Pairs of trees that stand next to each other in the 40 labels' order."""
    trees = p.select("cloud_id", F.col("itc").alias("src")).distinct()
    return trees.withColumn("dst", F.explode(F.array(*[F.pmod(F.col("src") + i, F.lit(40)) for i in range(1, 5)])))


_add(
    "semi_pair_lookup",
    on_points(lambda p: spatial.semi_pair_lookup(_all_pairs(p), _touching(p)).select("src", "dst", "touches")),
    f"WITH {TOUCHING}, pairs AS (SELECT DISTINCT itc AS src, (itc + i) % 40 AS dst FROM points, range(1, 5) t(i)) SELECT p.src, p.dst, t.src IS NOT NULL AS touches FROM pairs p LEFT JOIN touching t USING (src, dst)",
)
_add(
    "label_lookup",
    on_points(lambda p: spatial.label_lookup(grid.decimate(p, 2.0)[1], p.select("cloud_id", "pid", F.col("itc").alias("label"))).select("pid", "label")),
    f"WITH inv AS (SELECT pid, min(pid) OVER (PARTITION BY {cell('x', 2.0)}, {cell('y', 2.0)}, {cell('z', 2.0)}) AS rep FROM points) SELECT inv.pid, p.itc AS label FROM inv JOIN points p ON p.pid = inv.rep",
)
_add(
    "head_nn",
    on_both(lambda p, t: spatial.head_nn(p.withColumnRenamed("pid", "node_id"), t.withColumnRenamed("loc_id", "node_id"), 6.0).select("src", "dst", *r6("dist"), "rank")),
    f"SELECT src, dst, round(sqrt(d2), 6) AS dist, CAST(rank AS INT) AS rank FROM (SELECT src, dst, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM (SELECT a.pid AS src, b.loc_id AS dst, {D2} AS d2 FROM points a JOIN treeloc b USING (cloud_id)) WHERE d2 > 0 AND d2 < 36.0::DOUBLE) WHERE rank <= 4",
)
_add(
    "masked_split",
    on_points(lambda p: filters.drop_non_finite(spatial.masked_split(p, "stemoff")[0].withColumn("half", F.lit(1)).unionByName(spatial.masked_split(p, "stemoff")[1].withColumn("half", F.lit(0)))).groupBy("half").agg(F.count("*").alias("n"), F.sum("pid").alias("pids"))),
    "SELECT CAST(stemoff > 0 AS INT) AS half, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM points GROUP BY 1",
)
_add(
    "base_to_component",
    on_both(lambda p, t: spatial.base_to_component(t, p.withColumn("label", F.col("itc"))).select("loc_id", "label")),
    f"SELECT b.loc_id, arg_min(a.itc, ({D2}, a.pid)) AS label FROM treeloc b JOIN points a USING (cloud_id) GROUP BY 1",
)

# ---------------------------------------------------------------- aggregations

_add("cell_min", on_points(lambda p: agg.cell_min(grid.raster_key_lowerleft(p, 2.0)).select("row", "col", "value")), f"WITH {EXT} SELECT {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col, min(z) AS value FROM points JOIN ext USING (cloud_id) GROUP BY 1, 2")
_add("cell_mean", on_points(lambda p: agg.cell_mean(grid.raster_key_lowerleft(p, 2.0)).select("row", "col", *r6("value"))), f"WITH {EXT} SELECT {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col, round(avg(z), 6) AS value FROM points JOIN ext USING (cloud_id) GROUP BY 1, 2")
_add("component_median", on_points(lambda p: agg.component_median(p, "radius", "itc").select("itc", *r6("radius"))), "SELECT itc, round(median(radius), 6) AS radius FROM points GROUP BY 1")
_add("component_centroid", on_points(lambda p: agg.component_centroid(p, "itc").select("itc", *r6("x", "y", "z"), "n")), f"SELECT itc, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM points GROUP BY 1")
_add(
    "mode_positive",
    on_points(lambda p: agg.mode_positive(_labelled(p, 10.0), "stemoff", ("cloud_id", "label")).select("label", "mode")),
    f"""WITH l AS (SELECT {cell('x', 10.0)} * 10000 + {cell('y', 10.0)} * 100 + {cell('z', 10.0)} AS label, stemoff FROM points), c AS (SELECT label, stemoff, count(*) AS n FROM l WHERE stemoff > 0 GROUP BY 1, 2),
    r AS (SELECT label, stemoff, row_number() OVER (PARTITION BY label ORDER BY n DESC, stemoff) AS k FROM c) SELECT a.label, coalesce(r.stemoff, 0) AS mode FROM (SELECT DISTINCT label FROM l) a LEFT JOIN r ON r.label = a.label AND k = 1""",
)
_add(
    "component_size",
    on_points(lambda p: agg.component_size(_labelled(p).select("cloud_id", "pid", "label"), 5).select("pid", "component")),
    f"WITH {LABELLED} SELECT pid, CASE WHEN n >= 5 THEN n ELSE 0 END AS component FROM (SELECT pid, count(*) OVER (PARTITION BY label) AS n FROM lab)",
)
_add("segment_stem_flag", on_points(lambda p: agg.segment_stem_flag(p, "itc").select("itc", "is_stem")), "SELECT itc, max(stemcls) AS is_stem FROM points GROUP BY 1")


def _votes(p: DataFrame) -> DataFrame:
    return grid.block_voxelize(grid.sliding_blocks(p, SIDES[:2]), RES, SIZE).select("cloud_id", "pid", "block_id", (F.col("k") >= 20).alias("above"), F.pmod("k", F.lit(5)).cast("int").alias("label"))


VOTES = f"{_sql_blocks(SIDES[:2])}, {_sql_voxels()}, votes AS (SELECT pid, block_id, k >= 20 AS above, CAST(k % 5 AS INT) AS label FROM vox)"
_add("overlap_or", on_points(lambda p: agg.overlap_or(_votes(p)).select("pid", "label")), f"WITH {VOTES} SELECT pid, CAST(bool_or(above) AS INT) + 1 AS label FROM votes GROUP BY 1")
_add("overlap_last", on_points(lambda p: agg.overlap_last(p, _votes(p), 8).select("pid", "label")), f"WITH {VOTES} SELECT p.pid, coalesce(v.label, 7) AS label FROM points p LEFT JOIN (SELECT pid, arg_max(label, block_id) AS label FROM votes GROUP BY 1) v USING (pid)")
_add("seen_mask", on_points(lambda p: agg.seen_mask(p, _votes(p)).select("pid", "label")), f"WITH {VOTES} SELECT p.pid, coalesce(v.label, 2) AS label FROM points p LEFT JOIN (SELECT pid, CAST(bool_or(above) AS INT) + 1 AS label FROM votes GROUP BY 1) v USING (pid)")
_add("global_extent", on_points(grid.extent), "SELECT cloud_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY 1")
_add(
    "tree_stats",
    on_points(lambda p: agg.tree_stats(p.withColumn("dtm_z", F.col("conf"))).select("itc", *r6("x", "y", "z", "height"), "n", *r6("area"))),
    f"""WITH {_sql_hull('points')}, s AS (SELECT itc, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(max(z), 6) AS z, round(max(z) - (min(z) + min(conf)) * 0.5::DOUBLE, 6) AS height, count(*) AS n FROM points GROUP BY 1)
    SELECT s.*, round(area, 6) AS area FROM s JOIN hull ON label = itc""",
    recursive=True,
)
_add("hull_area", on_points(lambda p: agg.hull_area(p).select("itc", *r6("area"))), f"WITH {_sql_hull('points')} SELECT label AS itc, {q6('area')} FROM hull", recursive=True)
_add("argmin_row", on_points(lambda p: agg.argmin_row(p, ("cloud_id", "itc")).select("itc", "pid", "x", "y", "z")), "SELECT itc, arg_min(pid, (z, pid)) AS pid, arg_min(x, (z, pid)) AS x, arg_min(y, (z, pid)) AS y, min(z) AS z FROM points GROUP BY 1")
_add("distinct_rows", on_points(lambda p: agg.distinct_rows(p, "itc", "stemcls", "treefilter")), "SELECT DISTINCT itc, stemcls, treefilter FROM points")
_add(
    "voxel_mean_flag",
    on_points(lambda p: agg.voxel_mean_flag(grid.block_voxelize(grid.sliding_blocks(p, SIDES), (2.0, 2.0, 2.0), (10, 10, 10))).select("block_id", "voxel", *r6("mean_flag"))),
    f"WITH {_sql_blocks(SIDES)}, {_sql_voxels((2.0, 2.0, 2.0), (10, 10, 10))} SELECT block_id, voxel, round(avg(CAST(stemoff > 0 AS INT)), 6) AS mean_flag FROM vox GROUP BY 1, 2",
)
_add("segment_count", on_points(lambda p: agg.segment_count(p, "itc")), "SELECT cloud_id, count(DISTINCT itc) AS n_segments, count(*) AS n_points FROM points GROUP BY 1")
_add("multi_base_components", on_locations(lambda t: agg.multi_base_components(_labelled(t, 10.0)).select("label", "n_bases")), f"SELECT {cell('x', 10.0)} * 10000 + {cell('y', 10.0)} * 100 + {cell('z', 10.0)} AS label, count(*) AS n_bases FROM treeloc GROUP BY 1 HAVING count(*) > 1")

# ---------------------------------------------------------------- ordering



def _sql_nms(table: str) -> str:
    """CTE ``chosen(loc_id)``: tops of ``table`` in order, each kept unless a kept one beats it."""
    return f"""beaten AS (SELECT b.loc_id, list(a.loc_id) AS rivals FROM {table} a JOIN {table} b ON a.loc_id <> b.loc_id AND sqrt({D2XY}) <= (a.radius + b.radius) * 0.5::DOUBLE AND (a.z > b.z OR (a.z = b.z AND a.loc_id < b.loc_id)) GROUP BY 1),
    turns AS (SELECT row_number() OVER (ORDER BY z DESC, t.loc_id) AS k, t.loc_id, coalesce(rivals, []) AS rivals FROM {table} t LEFT JOIN beaten USING (loc_id)),
    served(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT t.k, CASE WHEN list_has_any(s.kept, t.rivals) THEN s.kept ELSE list_append(s.kept, t.loc_id) END FROM served s JOIN turns t ON t.k = s.k + 1),
    chosen AS (SELECT unnest(kept) AS loc_id FROM (SELECT kept FROM served ORDER BY k DESC LIMIT 1))"""


_add("nms", on_locations(lambda t: ranking.nms(t).select("loc_id", "x", "y", "z", "radius")), f"WITH {_sql_nms('treeloc')} SELECT loc_id, x, y, z, radius FROM treeloc SEMI JOIN chosen USING (loc_id)", recursive=True)
_add("order_by_distance_desc", on_points(lambda p: ranking.order_by_distance_desc(p, "z", "pid").select("pid", "seq")), "SELECT pid, CAST(row_number() OVER (ORDER BY z DESC, pid) - 1 AS INT) AS seq FROM points")
_add("argmin_over_targets", on_points(lambda p: ranking.argmin_over_targets(p, "itc", "conf", "pid").select("itc", "pid", "conf")), "SELECT itc, arg_min(pid, (conf, pid)) AS pid, min(conf) AS conf FROM points GROUP BY 1")
_add(
    "median_filter_3",
    on_points(lambda p: ranking.median_filter_3(_tree_paths(p)).select("path_id", "seq", "radius")),
    f"""WITH {SQL_PATHS}, w AS (SELECT *, lag(radius, 1, 0::DOUBLE) OVER v AS a, lead(radius, 1, 0::DOUBLE) OVER v AS b, count(*) OVER (PARTITION BY path_id) AS n FROM paths WINDOW v AS (PARTITION BY path_id ORDER BY seq))
    SELECT path_id, seq, CASE WHEN n > 3 THEN list_sort([a, radius, b])[2] ELSE radius END AS radius FROM w""",
)
_add("running_index", on_points(lambda p: ranking.running_index(p.withColumn("ok", F.col("treefilter") > 1), "ok", "pid").select("pid", "new_index")), "SELECT pid, CAST(sum(CAST(treefilter > 1 AS INT)) OVER (ORDER BY pid) - 1 AS BIGINT) AS new_index FROM points")
_add(
    "segment_vectors",
    on_points(lambda p: ranking.segment_vectors(_tree_paths(p)).select("path_id", "seq", *r6("length", "ux", "uy", "uz"))),
    f"""WITH {SQL_PATHS}, d AS (SELECT path_id, seq, x - lag(x) OVER v AS dx, y - lag(y) OVER v AS dy, z - lag(z) OVER v AS dz FROM paths WINDOW v AS (PARTITION BY path_id ORDER BY seq)), l AS (SELECT *, sqrt(0.0::DOUBLE + dx*dx + dy*dy + dz*dz) AS length FROM d)
    SELECT path_id, seq, round(length, 6) AS length, CASE WHEN length > 0 THEN round(dx / length, 6) END AS ux, CASE WHEN length > 0 THEN round(dy / length, 6) END AS uy, CASE WHEN length > 0 THEN round(dz / length, 6) END AS uz FROM l""",
)
_add(
    "constrain_radii",
    on_points(lambda p: ranking.constrain_radii(_tree_paths(p)).select("path_id", F.col("seq").alias("at"), *r6("radius"))),
    f"""WITH {SQL_PATHS}, w(path_id, seq, radius) AS (SELECT path_id, seq, radius FROM paths WHERE seq = 0
      UNION ALL SELECT p.path_id, p.seq, least(p.radius, 1.1::DOUBLE * w.radius) FROM w JOIN paths p ON p.path_id = w.path_id AND p.seq = w.seq + 1)
    SELECT path_id, seq AS at, round(radius, 6) AS radius FROM w""",
    recursive=True,
)
_add("farthest_reachable", on_points(lambda p: ranking.farthest_reachable(p, "z", "pid").select("pid", "z")), "SELECT arg_max(pid, (z, -pid)) AS pid, max(z) AS z FROM points")
_add(
    "moving_average",
    on_points(lambda p: ranking.moving_average(_tree_paths(p), "z", 3).select("path_id", "seq", *r6("mean"))),
    f"WITH {SQL_PATHS}, w AS (SELECT path_id, seq, avg(z) OVER (PARTITION BY path_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean FROM paths) SELECT path_id, seq, {q6('mean')} FROM w WHERE seq >= 2",
)
_add("first_occurrence", on_points(lambda p: ranking.first_occurrence(grid.voxel_key(p, 5.0), "i", "j", "k")), f"SELECT {cell('x', 5.0)} AS i, {cell('y', 5.0)} AS j, {cell('z', 5.0)} AS k, min(pid) AS first FROM points GROUP BY 1, 2, 3")
_add(
    "lowest_start",
    on_points(lambda p: ranking.lowest_start(agg.component_centroid(p.filter("stemcls > 1"), "itc").withColumnRenamed("itc", "segment").withColumn("is_stem", F.lit(1)))),
    "SELECT cloud_id, arg_min(itc, (z, itc)) AS start FROM (SELECT cloud_id, itc, avg(z) AS z FROM points WHERE stemcls > 1 GROUP BY 1, 2) GROUP BY 1",
)
_add(
    "topk_neighbours",
    on_points(lambda p: ranking.topk_neighbours(spatial.knn_bounded(p, 4, 3.0), 2).select("src", "dst", *r6("dist"))),
    f"WITH {_sql_bounded('points', 'pid', 2, 3.0)} SELECT src, dst, {q6('dist')} FROM near",
)
_add("union_reverse_pairs", on_points(lambda p: sets.union_reverse_pairs(_touching(p)).select("src", "dst")), f"WITH {TOUCHING} SELECT src, dst FROM touching UNION SELECT dst, src FROM touching")
_add(
    "not_in_used",
    on_both(lambda p, t: sets.not_in_used(p.withColumnRenamed("pid", "node_id"), t.withColumnRenamed("loc_id", "node_id")).select("node_id")),
    "SELECT pid AS node_id FROM points WHERE pid NOT IN (SELECT loc_id FROM treeloc)",
)

# ---------------------------------------------------------------- graphs


def _edges(p: DataFrame, bound: float = 2.0) -> DataFrame:
    return spatial.knn_bounded(p, 4, bound).select("cloud_id", "src", "dst", F.col("dist").alias("w"))


EDGES = f"{_sql_bounded('points', 'pid', 4, 2.0)}, e AS (SELECT src, dst, sum(dist) / 2 AS w FROM (SELECT src, dst, dist FROM near UNION ALL SELECT dst, src, dist FROM near) GROUP BY 1, 2)"


def _sql_cc(nodes: str, edges: str = "e") -> str:
    return f"""cc(id, lab) USING KEY (id) AS (SELECT id, id FROM ({nodes}) UNION SELECT e.dst, min(cc.lab) FROM cc JOIN {edges} e ON e.src = cc.id JOIN recurring.cc r ON r.id = e.dst WHERE cc.lab < r.lab GROUP BY e.dst)"""


_add("symmetrize", on_points(lambda p: graph.symmetrize(_edges(p)).select("src", "dst", *r6("w"))), f"WITH {EDGES} SELECT src, dst, {q6('w')} FROM e")
_add(
    "connected_components",
    on_points(lambda p: graph.connected_components(p, materialize(_edges(p), "edges")).select("pid", "label")),
    f"WITH {EDGES}, {_sql_cc('SELECT pid AS id FROM points')} SELECT id AS pid, lab AS label FROM cc",
    recursive=True,
)
VOX1 = f"{EXT}, key AS (SELECT pid, {cell('x - x0', 1.0)} AS i, {cell('y - y0', 1.0)} AS j, {cell('z - z0', 1.0)} AS k FROM points JOIN ext USING (cloud_id)), vx AS (SELECT min(pid) AS id, i::DOUBLE AS x, j::DOUBLE AS y, k::DOUBLE AS z FROM key GROUP BY i, j, k)"
_add(
    "noise_clean",
    on_points(lambda p: graph.noise_clean(p, 2.5, 3, 1.0).select("pid", F.col("component").cast("long").alias("component"))),
    f"""WITH {VOX1}, {_sql_bounded('vx', 'id', 10, 2.5)}, e AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near), {_sql_cc('SELECT id FROM vx')}, n AS (SELECT lab, count(*) AS n FROM cc GROUP BY 1)
    SELECT key.pid, CASE WHEN n >= 3 THEN n ELSE 0 END AS component FROM key JOIN vx ON vx.x = i AND vx.y = j AND vx.z = k JOIN cc ON cc.id = vx.id JOIN n USING (lab)""",
    recursive=True,
)
PEAKS = f"""{_sql_knn('treeloc', 'loc_id', 'treeloc', 'loc_id', 4, D2, True)}, e AS (SELECT src, dst FROM near WHERE dist < 6.0::DOUBLE UNION SELECT dst, src FROM near WHERE dist < 6.0::DOUBLE), {_sql_cc('SELECT loc_id AS id FROM treeloc')},
    peaks AS (SELECT lab AS loc_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, median(radius) AS radius FROM cc JOIN treeloc ON loc_id = id GROUP BY 1 HAVING median(radius) > 0.2)"""
_add(
    "peak_components",
    on_locations(lambda t: graph.peak_extract(t.withColumnRenamed("loc_id", "pid"), 5, 6.0, 0.2, 0.0).select("loc_id", *r6("x", "y", "z", "radius"))),
    f"WITH {PEAKS} SELECT loc_id, {q6('x', 'y', 'z', 'radius')} FROM peaks",
    recursive=True,
)
_add(
    "peak_extract",
    on_locations(lambda t: graph.peak_extract(t.withColumnRenamed("loc_id", "pid"), 5, 6.0, 0.2, 0.5).select("loc_id", *r6("x", "y", "z", "radius"))),
    f"WITH {PEAKS}, {_sql_nms('peaks')} SELECT loc_id, {q6('x', 'y', 'z', 'radius')} FROM peaks SEMI JOIN chosen USING (loc_id)",
    recursive=True,
)
SYMMETRIC = "sym AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, d3 AS w FROM best WHERE {keep} UNION ALL SELECT dst, src, d3 FROM best WHERE {keep}) GROUP BY 1, 2)"


def _node_graph(p: DataFrame, crowns: bool) -> DataFrame:
    return graph.node_graph(_labelled(p).withColumns({}), 4, 3.0, crowns).select("src", "dst", *r6("w"))


_add("node_graph_stems", on_points(lambda p: _node_graph(p, False)), f"WITH {LABELLED}, {CENTRES}, {_sql_knn('cen', 'label', 'cen', 'label', 4, D2XY, True)}, {CLOSEST}, {SYMMETRIC.format(keep='d2 < 3.0::DOUBLE')} SELECT src, dst, {q6('w')} FROM sym")
_add("node_graph_crowns", on_points(lambda p: _node_graph(p, True)), f"WITH {LABELLED}, {CENTRES}, {_sql_knn('cen', 'label', 'cen', 'label', 4, D2, True)}, {CLOSEST}, {SYMMETRIC.format(keep='d2 < 3.0::DOUBLE AND d3 < 6.0::DOUBLE')} SELECT src, dst, {q6('w')} FROM sym")


def _sources(p: DataFrame) -> DataFrame:
    return p.filter("stemcls > 1 and conf > 0.9").select("cloud_id", F.col("pid").alias("node"), F.col("pid").alias("target"))


def _weights(p: DataFrame) -> DataFrame:
    return materialize(graph.symmetrize(_edges(p, 3.0)).withColumn("w", F.round("w", 6)), "weights")


PATHS3 = f"""{_sql_bounded('points', 'pid', 4, 3.0)}, e AS (SELECT src, dst, round(sum(dist) / 2, 6) AS w FROM (SELECT src, dst, dist FROM near UNION ALL SELECT dst, src, dist FROM near) GROUP BY 1, 2),
    sp(id, d, tgt) USING KEY (id) AS (SELECT pid, 0::DOUBLE, pid FROM points WHERE stemcls > 1 AND conf > 0.9
      UNION SELECT c.dst, min(c.nd), arg_min(c.tgt, (c.nd, c.tgt)) FROM (SELECT e.dst, sp.d + e.w AS nd, sp.tgt FROM sp JOIN e ON e.src = sp.id) c LEFT JOIN recurring.sp r ON r.id = c.dst WHERE r.id IS NULL OR c.nd < r.d OR (c.nd = r.d AND c.tgt < r.tgt) GROUP BY c.dst)"""
_add("shortest_paths", on_points(lambda p: graph.shortest_paths(_weights(p), _sources(p), places=p.select("cloud_id", F.col("pid").alias("node"), "x", "y")).select("node", *r6("dist"))), f"WITH {PATHS3} SELECT id AS node, round(d, 6) AS dist FROM sp", recursive=True)
_add(
    "nearest_source_label",
    on_points(lambda p: graph.nearest_source_label(p.select("cloud_id", F.col("pid").alias("node"), "x", "y"), _weights(p), _sources(p)).select("node", "label")),
    f"WITH {PATHS3} SELECT pid AS node, coalesce(k, -1) AS label FROM points LEFT JOIN (SELECT id, dense_rank() OVER (ORDER BY tgt) - 1 AS k FROM sp) ON id = pid",
    recursive=True,
)
_add("touching_segments", on_points(lambda p: _touching(p).select("src", "dst")), f"WITH {TOUCHING} SELECT src, dst FROM touching")


def _tree_edges(p: DataFrame) -> DataFrame:
    return qsm.centroid_edges(qsm.segments_of(p, "itc"), 6).withColumn("w", F.round("w", 6))


SEGS = "seg AS (SELECT cloud_id, itc AS label, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n, CAST(max(CASE WHEN itc % 3 = 0 THEN 1 ELSE 0 END) AS INT) AS is_stem FROM points GROUP BY 1, 2)"
_add(
    "weight_shaping",
    on_points(lambda p: graph.weight_shaping(_tree_edges(p), _touching(p), 8.0, 0.03, p.select("cloud_id", F.col("itc").alias("segment"), (F.pmod("itc", F.lit(3)) == 0).cast("int").alias("is_stem")).distinct()).select("src", "dst", *r6("w"))),
    f"""WITH {TOUCHING.replace("near AS", "nearp AS").replace("FROM near n", "FROM nearp n")}, {SEGS}, {_sql_knn('seg', 'label', 'seg', 'label', 6, D2, True)}, tt AS (SELECT src, dst FROM touching UNION SELECT dst, src FROM touching),
    s AS (SELECT n.src, n.dst, CASE WHEN t.src IS NOT NULL THEN pow(round(dist, 6) * 0.03::DOUBLE, 2) ELSE round(dist, 6) END AS w FROM near n LEFT JOIN tt t USING (src, dst))
    SELECT src, dst, {q6('w')} FROM s WHERE w <= 8 AND NOT (src % 3 = 0 AND dst % 3 = 0)""",
)


def _stem_of(p: DataFrame) -> DataFrame:
    segs = qsm.segments_of(p, "itc").withColumn("is_stem", F.lit(1))
    return graph.find_stem(segs, qsm.undirected(_tree_edges(p))).select("seq", "node_id")


def _sql_tree(first: str) -> str:
    """CTEs of the tree of shortest paths over the segments from those in ``first``: ``sp(id, d, prev)``."""
    return f"""{SEGS}, {_sql_knn('seg', 'label', 'seg', 'label', 6, D2, True)}, e AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, round(dist, 6) AS w FROM near UNION ALL SELECT dst, src, round(dist, 6) FROM near) GROUP BY 1, 2),
    sp(id, d, prev) USING KEY (id) AS (SELECT label, 0::DOUBLE, NULL::BIGINT FROM seg WHERE label IN ({first})
      UNION SELECT c.dst, min(c.nd), arg_min(c.src, (c.nd, c.src)) FROM (SELECT e.dst, sp.d + e.w AS nd, e.src FROM sp JOIN e ON e.src = sp.id) c LEFT JOIN recurring.sp r ON r.id = c.dst WHERE r.id IS NULL OR c.nd < r.d GROUP BY c.dst)"""


_add(
    "find_stem",
    on_points(_stem_of),
    f"""WITH {_sql_tree('SELECT arg_min(label, (z, label)) FROM seg')},
    back(node, k) AS (SELECT arg_max(id, (d, -id)), 0 FROM sp UNION ALL SELECT sp.prev, k + 1 FROM back JOIN sp ON sp.id = back.node WHERE sp.prev IS NOT NULL)
    SELECT CAST(max(k) OVER () - k AS INT) AS seq, node AS node_id FROM back""",
    recursive=True,
)
_add(
    "path_tree",
    on_points(lambda p: qsm.path_tree(materialize(qsm.undirected(_tree_edges(p)), "e"), p.filter("itc = 0").select("cloud_id", F.col("itc").alias("node")).distinct(), 1e9).select("path_id", "seq", "node_id")),
    f"""WITH {_sql_tree('SELECT 0')}, above(id, up) AS (SELECT id, id FROM sp WHERE d > 0 UNION ALL SELECT a.id, sp.prev FROM above a JOIN sp ON sp.id = a.up JOIN sp u ON u.id = sp.prev AND u.d > 0),
    lead AS (SELECT up AS node, arg_min(a.id, (-d, a.id)) AS lead FROM above a JOIN sp ON sp.id = a.id GROUP BY 1), depth AS (SELECT id AS node, count(*) AS depth FROM above GROUP BY 1),
    num AS (SELECT id AS lead, row_number() OVER (ORDER BY d DESC, id) AS path_id FROM sp SEMI JOIN lead l ON l.lead = sp.id),
    placed AS (SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY depth) AS seq, node FROM lead JOIN num USING (lead) JOIN depth USING (node))
    SELECT CAST(path_id AS INT) AS path_id, CAST(seq AS INT) AS seq, node AS node_id FROM placed UNION ALL SELECT CAST(path_id AS INT), 0, prev FROM placed JOIN sp ON sp.id = node WHERE seq = 1""",
    recursive=True,
)
_add("stem_clusters", on_both(lambda p, t: segment.stem_clusters(p, t, 1.0, 6.0).select("pid", "stemoff")))


def _sql_nearest_label(edges: str, sources: str) -> str:
    """CTE ``sp(id, d, tgt)``: the nearest of ``sources`` along ``edges``, the smaller of equals."""
    return f"""sp(id, d, tgt) USING KEY (id) AS (SELECT id, 0::DOUBLE, id FROM ({sources})
      UNION SELECT c.dst, min(c.nd), arg_min(c.tgt, (c.nd, c.tgt)) FROM (SELECT e.dst, sp.d + e.w AS nd, sp.tgt FROM sp JOIN {edges} e ON e.src = sp.id) c LEFT JOIN recurring.sp r ON r.id = c.dst WHERE r.id IS NULL OR c.nd < r.d OR (c.nd = r.d AND c.tgt < r.tgt) GROUP BY c.dst)"""


REPS = f"reps AS (SELECT *, min(pid) OVER (PARTITION BY {cell('x', 1.0)}, {cell('y', 1.0)}, {cell('z', 1.0)}) AS rep FROM {{table}})"
_add(
    "stem_clusters_unsplit",
    on_both(lambda p, t: segment.stem_clusters(p, t, 1.0, 6.0, split=False).select("pid", "stemoff")),
    f"""WITH stems AS (SELECT * FROM points WHERE stemcls > 1), {REPS.format(table='stems')}, own AS (SELECT * FROM reps WHERE pid = rep),
    {_sql_bounded('own', 'pid', 10, 3.0).replace('near AS', 'near0 AS')}, e0 AS (SELECT src, dst FROM near0 UNION SELECT dst, src FROM near0), {_sql_cc('SELECT pid AS id FROM own', 'e0')},
    lab AS (SELECT own.*, cc.lab AS label FROM own JOIN cc ON cc.id = pid), {CENTRES}, {_sql_knn('cen', 'label', 'cen', 'label', 10, D2XY, True)}, {CLOSEST}, {SYMMETRIC.format(keep='d2 < 6.0::DOUBLE')},
    base AS (SELECT DISTINCT label FROM (SELECT b.loc_id, arg_min(a.label, ({D2}, a.pid)) AS label FROM treeloc b JOIN lab a USING (cloud_id) GROUP BY 1)), {_sql_nearest_label('sym', 'SELECT label AS id FROM base')},
    ranks AS (SELECT id, dense_rank() OVER (ORDER BY tgt) AS stem FROM sp)
    SELECT p.pid, coalesce(ranks.stem, 0) AS stemoff FROM points p LEFT JOIN reps r ON r.pid = p.pid LEFT JOIN lab ON lab.pid = r.rep LEFT JOIN ranks ON ranks.id = lab.label""",
    recursive=True,
)
_add(
    "crown_clusters",
    on_points(lambda p: segment.crown_clusters(_labelled(p).withColumn("init_segs", F.col("label")).withColumn("treeoff", F.col("stemoff")), 1.0, 6.0, 8).select("pid", "itc")),
    f"""WITH {LABELLED.replace('lab AS', 'every AS')}, {REPS.format(table='every')}, lab AS (SELECT * FROM reps WHERE pid = rep), {CENTRES}, {_sql_knn('cen', 'label', 'cen', 'label', 8, D2, True)}, {CLOSEST}, {SYMMETRIC.format(keep='d2 < 6.0::DOUBLE AND d3 < 12.0::DOUBLE')},
    votes AS (SELECT label, stemoff, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, stemoff) AS k FROM lab WHERE stemoff > 0 GROUP BY 1, 2), modes AS (SELECT label, stemoff AS mode FROM votes WHERE k = 1), {_sql_nearest_label('sym', 'SELECT label AS id FROM modes')},
    near_mode AS (SELECT sp.id, sp.tgt, own.mode FROM sp LEFT JOIN modes own ON own.label = sp.id), per AS (SELECT tgt, mode, row_number() OVER (PARTITION BY tgt ORDER BY count(*) DESC, mode) AS k FROM near_mode WHERE mode IS NOT NULL GROUP BY 1, 2)
    SELECT e.pid, CASE WHEN e.stemoff > 0 THEN e.stemoff ELSE coalesce(per.mode, 0) END AS itc FROM every e JOIN reps r ON r.pid = e.pid JOIN lab ON lab.pid = r.rep LEFT JOIN sp ON sp.id = lab.label LEFT JOIN per ON per.tgt = sp.tgt AND per.k = 1""",
    recursive=True,
)
_add(
    "treelabel_chain",
    on_points(lambda p: segment.treelabel_chain(_labelled(p, 10.0).select("cloud_id", "pid", F.col("label").alias("cluster"), F.col("stemoff").alias("treeoff"))).select("pid", "pred")),
    f"""WITH l AS (SELECT pid, {cell('x', 10.0)} * 10000 + {cell('y', 10.0)} * 100 + {cell('z', 10.0)} AS label, stemoff FROM points), c AS (SELECT label, stemoff, count(*) AS n FROM l WHERE stemoff > 0 GROUP BY 1, 2),
    r AS (SELECT label, stemoff, row_number() OVER (PARTITION BY label ORDER BY n DESC, stemoff) AS k FROM c) SELECT l.pid, coalesce(r.stemoff, 0) AS pred FROM l LEFT JOIN r ON r.label = l.label AND k = 1""",
)
_add("superpoints", on_points(lambda p: superpoints.superpoints(p, 1.0, 5, 20.0).select("pid", "init_segs")))
_add("mixture_split", on_both(lambda p, t: superpoints.mixture_split(_labelled(p, 10.0), _labelled(t, 10.0)).select("pid", "label", "part")))
_add("init_segments", on_points(lambda p: superpoints.init_segments(filters.normalize_class(p), 1.0, 5, 20.0, 5, 20.0).select("pid", "init_segs")))


def _short_paths(p: DataFrame) -> DataFrame:
    """Paths over the 40 trees as segments: path i runs over trees 4i to 4i + 3, from tree 4i - 1."""
    trees = p.select("cloud_id", "itc").distinct()
    return trees.select("cloud_id", F.floor(F.col("itc") / 4).cast("int").alias("path_id"), F.pmod("itc", F.lit(4)).cast("int").alias("seq"), F.col("itc").alias("node_id"))


SHORT = "sp AS (SELECT DISTINCT CAST(itc // 4 AS INT) AS path_id, CAST(itc % 4 AS INT) AS seq, itc AS node_id FROM points)"
_add(
    "refine_heads",
    on_points(lambda p: qsm.refine_heads(_short_paths(p), qsm.segments_of(p, "itc"), 20.0).select("path_id", "seq", "node_id")),
    f"""WITH {SEGS}, {SHORT}, v AS (SELECT path_id, seq, node_id, x, y, z FROM sp JOIN seg ON label = node_id),
    near AS (SELECT * FROM (SELECT s.path_id, h.node_id AS head, row_number() OVER (PARTITION BY s.path_id ORDER BY {D2.replace('a.', 's.').replace('b.', 'h.')}, h.path_id) AS rank, s.x - h.x AS ax, s.y - h.y AS ay, s.z - h.z AS az
      FROM v s JOIN v h ON s.seq = 1 AND h.seq = 0 WHERE {D2.replace('a.', 's.').replace('b.', 'h.')} > 0 AND {D2.replace('a.', 's.').replace('b.', 'h.')} < 400.0::DOUBLE) WHERE rank <= 4),
    third AS (SELECT s.path_id, t.x - s.x AS bx, t.y - s.y AS by_, t.z - s.z AS bz FROM v s JOIN v t ON s.path_id = t.path_id AND s.seq = 1 AND t.seq = 2),
    best AS (SELECT path_id, arg_min(head, (acos(greatest(least((ax*bx+ay*by_+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+by_*by_+bz*bz)), 1), -1)), rank)) AS head FROM near JOIN third USING (path_id) GROUP BY 1)
    SELECT sp.path_id, sp.seq, CASE WHEN seq = 0 AND head IS NOT NULL THEN head ELSE node_id END AS node_id FROM sp LEFT JOIN best USING (path_id)""",
)


def _stubs(p: DataFrame) -> DataFrame:
    return _short_paths(p).filter("path_id % 2 = 0 or seq < 2")


_add(
    "clean_tree",
    on_points(lambda p: qsm.clean_tree(_stubs(p), qsm.segments_of(p, "itc"), 370).select("path_id", "seq", "node_id")),
    f"""WITH {SEGS}, {SHORT}, st AS (SELECT * FROM sp WHERE path_id % 2 = 0 OR seq < 2), ends AS (SELECT path_id, count(*) AS m, arg_max(node_id, seq) AS tip FROM st GROUP BY 1)
    SELECT path_id, seq, node_id FROM st WHERE path_id NOT IN (SELECT path_id FROM ends JOIN seg ON label = tip WHERE m < 3 AND n <= 370)""",
)
_add(
    "node_radius",
    on_points(lambda p: qsm.node_radius(p, _short_paths(p), qsm.segments_of(p, "itc"), segment="itc", circle="moments").select("path_id", "seq", "node_id", *r6("x", "y", "z", "radius"))),
    f"""WITH {SEGS}, {SHORT}, v AS (SELECT path_id, seq, node_id, x, y, z, {', '.join(f'{c} - lag({c}) OVER w AS d{c}' for c in 'xyz')} FROM sp JOIN seg ON label = node_id WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
    u AS (SELECT *, {', '.join(f'd{c} / sqrt(dx*dx + dy*dy + dz*dz) AS u{c}' for c in 'xyz')} FROM v WHERE seq > 0), pr AS (SELECT path_id, seq, p.x, p.y, ux, uy, (p.x - u.x) * ux + (p.y - u.y) * uy + (p.z - u.z) * uz AS t FROM u JOIN points p ON p.itc = node_id),
    fl AS (SELECT path_id, seq, x - t * ux AS px, y - t * uy AS py FROM pr), ce AS (SELECT path_id, seq, px - avg(px) OVER w AS u, py - avg(py) OVER w AS v FROM fl WINDOW w AS (PARTITION BY path_id, seq) QUALIFY count(*) OVER w > 4),
    mo AS (SELECT path_id, seq, median(sqrt(u*u+v*v)) AS r0, count(*) AS n, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, sum(u*(u*u+v*v)) AS sa, sum(v*(u*u+v*v)) AS sb FROM ce GROUP BY 1, 2),
    ft AS (SELECT *, (sa*svv - sb*suv) / (2 * (suu*svv - suv*suv)) AS cu, (sb*suu - sa*suv) / (2 * (suu*svv - suv*suv)) AS cv FROM mo), fr AS (SELECT *, sqrt(cu*cu + cv*cv + (suu + svv) / n) AS r FROM ft),
    sg AS (SELECT path_id, seq, sqrt(avg(pow(sqrt((u-cu)*(u-cu) + (v-cv)*(v-cv)) - r, 2))) AS sigma FROM ce JOIN fr USING (path_id, seq) GROUP BY 1, 2),
    rd AS (SELECT u.path_id, u.seq, node_id, x, y, z, coalesce(CASE WHEN sigma / r > 0.3 THEN r0 ELSE least(r, r0 * 1.2::DOUBLE) END, 0.04::DOUBLE) AS radius FROM u LEFT JOIN fr USING (path_id, seq) LEFT JOIN sg USING (path_id, seq)),
    md AS (SELECT * REPLACE (CASE WHEN count(*) OVER (PARTITION BY path_id) > 3 THEN list_sort([lag(radius, 1, 0::DOUBLE) OVER w, radius, lead(radius, 1, 0::DOUBLE) OVER w])[2] ELSE radius END AS radius) FROM rd WINDOW w AS (PARTITION BY path_id ORDER BY seq))
    SELECT path_id, seq, node_id, {q6('x', 'y', 'z', 'radius')} FROM md UNION ALL SELECT v.path_id, v.seq, v.node_id, round(v.x, 6), round(v.y, 6), round(v.z, 6), round(coalesce(md.radius, 0.04), 6) FROM v LEFT JOIN md ON md.path_id = v.path_id AND md.seq = 1 WHERE v.seq = 0""",
)


_add("node_radius_riemann", on_points(lambda p: qsm.node_radius(p, _short_paths(p), qsm.segments_of(p, "itc"), segment="itc").select("path_id", "seq", "node_id", *r6("x", "y", "z", "radius"))))


def _qsm(spark: SparkSession, d: str) -> DataFrame:
    p = filters.normalize_class(points(spark, d))
    segs = superpoints.init_segments(p, 2.0, 5, 50.0, 5, 50.0)
    nodes, _, _ = qsm.qsm(p.join(materialize(segs, "segs"), ["cloud_id", "pid"]), 6, 1e9, 4.0, 30.0)
    return nodes.select("path_id", "seq", "node_id", *r6("x", "y", "z", "radius"))


_add("qsm", _qsm)

# ---------------------------------------------------------------- rasters and geometry



def _sql_dtm(fill: bool) -> str:
    """CTE ``dtm(row, col, x, y, z)``: tiles of 30 m widened by 4 m, cells of 2 m, each step by its definition."""
    held = {a: f"(({a} - g{a}0) - 4.0::DOUBLE) / 30.0::DOUBLE <= {t} + 1 AND (({a} - g{a}0) + 4.0::DOUBLE) / 30.0::DOUBLE >= {t}" for a, t in (("x", "ti"), ("y", "tj"))}
    spans = [f"(SELECT t AS {t} FROM range(0, 1000) r(t)) {t}s ON {t} < ceil((g{a}1 - g{a}0) / 30.0::DOUBLE) AND {held[a]}" for a, t in (("x", "ti"), ("y", "tj"))]
    weights = f"""w AS (SELECT ti, tj, row + a AS row, col + b AS col, sum(value / (a*a+b*b)) / sum(1.0::DOUBLE / (a*a+b*b)) AS value FROM rc, off WHERE a <> 0 OR b <> 0 GROUP BY 1, 2, 3, 4),
    fl AS (SELECT * FROM rc UNION ALL SELECT w.* FROM w JOIN own USING (ti, tj) ANTI JOIN rc USING (ti, tj, row, col) WHERE row >= 0 AND col >= 0 AND row <= floor((yb - ya) / 2.0::DOUBLE) AND col <= floor((xb - xa) / 2.0::DOUBLE))"""
    return f"""g0 AS (SELECT x, y, z FROM points WHERE treefilter <= 1), gx AS (SELECT min(x) AS gx0, max(x) AS gx1, min(y) AS gy0, max(y) AS gy1 FROM g0),
    tl AS (SELECT x, y, z, ti, tj FROM g0 CROSS JOIN gx JOIN {spans[0]} JOIN {spans[1]}), own AS (SELECT ti, tj, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM tl GROUP BY 1, 2),
    rc AS (SELECT ti, tj, {cell('y - ya', 2.0)} AS row, {cell('x - xa', 2.0)} AS col, min(z) AS value FROM tl JOIN own USING (ti, tj) GROUP BY 1, 2, 3, 4), off AS (SELECT a, b FROM range(-5, 6) t(a), range(-5, 6) u(b) WHERE a*a + b*b <= 25),
    {weights if fill else 'fl AS (SELECT * FROM rc)'}, sm AS (SELECT v.ti, v.tj, v.row, v.col, median(v.value) AS value FROM (SELECT ti, tj, row - a AS row, col - b AS col, value FROM fl, off) v SEMI JOIN fl r ON r.ti = v.ti AND r.tj = v.tj AND r.row = v.row AND r.col = v.col GROUP BY 1, 2, 3, 4),
    pl AS (SELECT ti, tj, row AS r, col AS c, xa + col * 2.0::DOUBLE AS x, ya + row * 2.0::DOUBLE AS y, value FROM sm JOIN own USING (ti, tj)),
    dtm AS (SELECT {cell('y - gy0', 2.0)} AS row, {cell('x - gx0', 2.0)} AS col, arg_min(x, (ti, tj, r, c)) AS x, arg_min(y, (ti, tj, r, c)) AS y, avg(value) AS z FROM pl, gx GROUP BY 1, 2)"""


_add("dtm", on_points(lambda p: raster.dtm(p, 2.0, 30.0, 4.0, fill="idw").select("row", "col", *r6("x", "y", "z"))), f"WITH {_sql_dtm(True)} SELECT row, col, {q6('x', 'y', 'z')} FROM dtm")
_add("dtm_unfilled", on_points(lambda p: raster.dtm(p, 2.0, 30.0, 4.0, fill="none").select("row", "col", *r6("x", "y", "z"))), f"WITH {_sql_dtm(False)} SELECT row, col, {q6('x', 'y', 'z')} FROM dtm")
_add(
    "dtm_stats",
    on_points(lambda p: raster.dtm_stats(p, 2.0, frame=p).select("row", "col", *r6("x", "y", "z"))),
    f"WITH {INVENTORY} SELECT i AS row, j AS col, round(cx, 6) AS x, round(cy, 6) AS y, round(gz, 6) AS z FROM cells",
)


def _ground_cells(p: DataFrame) -> DataFrame:
    return materialize(agg.cell_min(grid.raster_key_lowerleft(filters.filter_ground(p), 2.0)), "cells")


GROUND = f"g0 AS (SELECT * FROM points WHERE treefilter <= 1), gx AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM g0), rc AS (SELECT {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col, min(z) AS value FROM g0, gx GROUP BY 1, 2), off AS (SELECT a, b FROM range(-5, 6) t(a), range(-5, 6) u(b) WHERE a*a + b*b <= 25)"
_add(
    "fill_gaps_idw",
    on_points(lambda p: raster.fill_gaps(_ground_cells(p), "idw", 5, raster.raster_shape(filters.filter_ground(p), 2.0)).select("row", "col", *r6("value"))),
    f"""WITH {GROUND}, w AS (SELECT row + a AS row, col + b AS col, sum(value / (a*a+b*b)) / sum(1.0::DOUBLE / (a*a+b*b)) AS value FROM rc, off WHERE a <> 0 OR b <> 0 GROUP BY 1, 2)
    SELECT row, col, {q6('value')} FROM (SELECT * FROM rc UNION ALL SELECT w.* FROM w ANTI JOIN rc USING (row, col)), gx WHERE row >= 0 AND col >= 0 AND row <= floor((y1 - y0) / 2.0::DOUBLE) AND col <= floor((x1 - x0) / 2.0::DOUBLE)""",
)
_add(
    "fill_gaps_nearest",
    on_points(lambda p: raster.fill_gaps(_ground_cells(p), "nearest", 5, raster.raster_shape(filters.filter_ground(p), 2.0)).select("row", "col", "value")),
    f"""WITH {GROUND}, w AS (SELECT row + a AS row, col + b AS col, arg_min(value, (a*a+b*b, row, col)) AS value FROM rc, off WHERE a <> 0 OR b <> 0 GROUP BY row + a, col + b)
    SELECT row, col, value FROM (SELECT * FROM rc UNION ALL SELECT w.* FROM w ANTI JOIN rc USING (row, col)), gx WHERE row >= 0 AND col >= 0 AND row <= floor((y1 - y0) / 2.0::DOUBLE) AND col <= floor((x1 - x0) / 2.0::DOUBLE)""",
)
RAISED = "1e-4::DOUBLE * ((((r * r * 7919 + r * c * 6151 + c * c * 4421 + r * 3571 + c * 2879) % 65521) + 65521) % 65521 / 65521::DOUBLE)"
_add(
    "fill_gaps_linear",
    on_points(lambda p: raster.fill_gaps(_ground_cells(p), "linear", shape=raster.raster_shape(filters.filter_ground(p), 2.0), reach=3).select("row", "col", *r6("value"))),
    f"""WITH {GROUND}, occ AS MATERIALIZED (SELECT row, col, value, {RAISED} AS up FROM (SELECT *, row AS r, col AS c FROM rc)),
    q AS (SELECT r.row + a AS row, r.col + b AS col FROM rc r, range(-3, 4) t(a), range(-3, 4) u(b) GROUP BY 1, 2), ask AS (SELECT q.* FROM q ANTI JOIN rc USING (row, col) CROSS JOIN gx WHERE row >= 0 AND col >= 0 AND row <= floor((y1 - y0) / 2.0::DOUBLE) AND col <= floor((x1 - x0) / 2.0::DOUBLE)),
    n AS MATERIALIZED (SELECT a.row, a.col, o.row - a.row AS y, o.col - a.col AS x, o.value, (o.row - a.row) * (o.row - a.row) + (o.col - a.col) * (o.col - a.col) + o.up AS h FROM ask a, range(-3, 4) t(i), range(-3, 4) u(j), occ o WHERE o.row = a.row + i AND o.col = a.col + j),
    tri AS (SELECT a.row, a.col, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS byy, c.x AS cx, c.y AS cy, a.h AS ah, b.h AS bh, c.h AS ch, a.value AS av, b.value AS bv, c.value AS cv, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS det
      FROM n a JOIN n b ON b.row = a.row AND b.col = a.col AND (b.y, b.x) > (a.y, a.x) JOIN n c ON c.row = a.row AND c.col = a.col AND (c.y, c.x) > (b.y, b.x)),
    w AS (SELECT *, ((s * 1e-6 - ax) * (cy - ay) - (s * 0.618e-6 - ay) * (cx - ax)) / det AS w1, ((s * 0.618e-6 - ay) * (bx - ax) - (s * 1e-6 - ax) * (byy - ay)) / det AS w2, (ay * (cx - ax) - ax * (cy - ay)) / det AS v1, (ax * (byy - ay) - ay * (bx - ax)) / det AS v2 FROM tri, (VALUES (1), (-1)) side(s) WHERE det <> 0),
    best AS (SELECT * FROM w WHERE w1 >= 0 AND w2 >= 0 AND w1 + w2 <= 1 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY s DESC, ah + w1 * (bh - ah) + w2 * (ch - ah)) = 1),
    pl AS (SELECT *, ((bh - ah) * (cy - ay) - (ch - ah) * (byy - ay)) / det AS p, ((bx - ax) * (ch - ah) - (cx - ax) * (bh - ah)) / det AS q FROM best),
    f AS (SELECT row, col, av + v1 * (bv - av) + v2 * (cv - av) AS value FROM pl WHERE greatest(abs(p), abs(q)) / 2 + sqrt(greatest(0, ah - p * ax - q * ay + (p * p + q * q) / 4)) < 3.3137)
    SELECT row, col, {q6('value')} FROM (SELECT row, col, value FROM rc UNION ALL SELECT * FROM f)""",
)
_add("fill_gaps_cubic", on_points(lambda p: raster.fill_gaps(_ground_cells(p), "cubic", shape=raster.raster_shape(filters.filter_ground(p), 2.0)).select("row", "col", *r6("value"))))
_add("dtm_cubic", on_points(lambda p: raster.dtm(p, 2.0, 30.0, 4.0).select("row", "col", *r6("x", "y", "z"))))
_add("median_disk5", on_points(lambda p: raster.median_disk(_ground_cells(p)).select("row", "col", *r6("value"))), f"WITH {GROUND} SELECT r.row, r.col, round(median(s.value), 6) AS value FROM rc r JOIN off ON true JOIN rc s ON s.row = r.row + a AND s.col = r.col + b GROUP BY 1, 2")


def _image(p: DataFrame) -> DataFrame:
    return grid.raster_key_lowerleft(p.filter("stemcls > 1"), 2.0)


IMAGE = f"s0 AS (SELECT * FROM points WHERE stemcls > 1), sx AS (SELECT min(x) AS x0, min(y) AS y0 FROM s0), im AS (SELECT DISTINCT {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col FROM s0, sx), px AS (SELECT row * 16777216 + col AS id, row, col FROM im)"
_add(
    "label_image",
    on_points(lambda p: raster.label_image(_image(p)).select("label", *r6("row", "col"), "n")),
    f"WITH {IMAGE}, e AS (SELECT a.id AS src, b.id AS dst FROM px a JOIN (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j) WHERE i <> 0 OR j <> 0) ON true JOIN px b ON b.row = a.row + i AND b.col = a.col + j), {_sql_cc('SELECT id FROM px')} SELECT lab AS label, round(avg(row), 6) AS row, round(avg(col), 6) AS col, count(*) AS n FROM cc JOIN px USING (id) GROUP BY 1",
    recursive=True,
)


def _mask(p: DataFrame) -> DataFrame:
    keyed = grid.raster_key_lowerleft(p, 2.0).groupBy("cloud_id", "row", "col").agg(F.max("conf").alias("value"))
    low = p.groupBy("cloud_id").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"))
    return keyed.join(low, "cloud_id")


_add(
    "treeloc_stem_peaks",
    on_points(lambda p: raster.treeloc_stem_peaks(_mask(p), p, 2.0, 2.0, 0.95).select("peak_id", "x", "y", "z")),
    f"""WITH {EXT}, px AS (SELECT {cell('y - y0', 2.0)} * 16777216 + {cell('x - x0', 2.0)} AS id, {cell('y - y0', 2.0)} AS row, {cell('x - x0', 2.0)} AS col FROM points JOIN ext USING (cloud_id) GROUP BY ALL HAVING max(conf) > 0.95),
    e AS (SELECT a.id AS src, b.id AS dst FROM px a JOIN (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j) WHERE i <> 0 OR j <> 0) ON true JOIN px b ON b.row = a.row + i AND b.col = a.col + j), {_sql_cc('SELECT id FROM px')},
    b AS (SELECT lab AS peak_id, x0 + avg(col) * 2.0::DOUBLE AS x, y0 + avg(row) * 2.0::DOUBLE AS y FROM cc JOIN px USING (id), ext GROUP BY lab, x0, y0)
    SELECT b.peak_id, arg_min(a.x, (a.z, a.pid)) AS x, arg_min(a.y, (a.z, a.pid)) AS y, min(a.z) AS z FROM points a JOIN b ON {D2XY} <= 4.0::DOUBLE GROUP BY 1""",
    recursive=True,
)
_add("tube_samples", lambda spark, d: qsm.tube_samples(_skeleton(spark, d), 1.0).select("cloud_id", "path_id", "i", *r6("x", "y", "z", "radius")))


def _samples(p: DataFrame) -> DataFrame:
    return _tree_paths(p).withColumnRenamed("seq", "i")


_add("tube_mesh_faces", on_points(lambda p: qsm.tube_mesh(_samples(p), 8)[1].select("path_id", "v1", "v2", "v3", "v4")), f"WITH {SQL_PATHS}, s AS (SELECT path_id, seq AS i, max(seq) OVER (PARTITION BY path_id) AS m FROM paths) SELECT path_id, CAST(i * 8 + j AS INT) AS v1, CAST(i * 8 + (j + 1) % 8 AS INT) AS v2, CAST((i + 1) * 8 + (j + 1) % 8 AS INT) AS v3, CAST((i + 1) * 8 + j AS INT) AS v4 FROM s, range(8) t(j) WHERE i < m")
_add(
    "tube_mesh_vertices",
    on_points(lambda p: qsm.tube_mesh(_samples(p), 8)[0].select("path_id", "vid", *r6("x", "y", "z"))),
    f"""WITH {SQL_PATHS}, d AS (SELECT *, {', '.join(f'coalesce(lead({c}) OVER v - {c}, {c} - lag({c}) OVER v) AS d{c}' for c in 'xyz')} FROM paths WINDOW v AS (PARTITION BY path_id ORDER BY seq)),
    u AS (SELECT *, {', '.join(f'd{c} / sqrt(dx*dx + dy*dy + dz*dz) AS z{c}' for c in 'xyz')} FROM d), a AS (SELECT *, CASE WHEN abs(zx - 1) <= 1.001e-5 AND abs(zy) <= 1e-8 AND abs(zz) <= 1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ay FROM u),
    y AS (SELECT *, -zz * ay AS yx, zz * (1 - ay) AS yy, zx * ay - zy * (1 - ay) AS yz FROM a), f AS (SELECT *, yy * zz - yz * zy AS xx, yz * zx - yx * zz AS xy, yx * zy - yy * zx AS xz FROM y), ring AS (SELECT *, j * (2 * pi() / 8) AS t FROM f, range(8) r(j))
    SELECT path_id, CAST(seq * 8 + j AS INT) AS vid, {', '.join(f'round({c} + radius * cos(t) * x{c} / sqrt(xx*xx + xy*xy + xz*xz) + radius * sin(t) * y{c} / sqrt(yx*yx + yy*yy + yz*yz), 6) AS {c}' for c in 'xyz')} FROM ring""",
)


def _holed(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A mesh in which every eleventh vertex is NaN and no other, as the SQL says: rings without a direction get a place."""
    v, f = qsm.tube_mesh(_samples(p), 8)
    v = v.withColumns({c: F.nanvl(c, F.lit(0.0)) for c in "xyz"})
    return v.withColumn("z", F.when(F.pmod("vid", F.lit(11)) == 0, F.lit(float("nan"))).otherwise(F.col("z"))), f


FACES = "s AS (SELECT path_id, seq AS i, max(seq) OVER (PARTITION BY path_id) AS m FROM paths), faces AS (SELECT path_id, i * 8 + j AS v1, i * 8 + (j + 1) % 8 AS v2, (i + 1) * 8 + (j + 1) % 8 AS v3, (i + 1) * 8 + j AS v4 FROM s, range(8) t(j) WHERE i < m)"
_add(
    "drop_nan_vertices",
    on_points(lambda p: qsm.drop_nan_vertices(*_holed(p))[1].select("path_id", "v1", "v2", "v3", "v4")),
    f"""WITH {SQL_PATHS}, {FACES}, num AS MATERIALIZED (SELECT path_id, vid, sum(CAST(vid % 11 <> 0 AS BIGINT)) OVER (PARTITION BY path_id ORDER BY vid) - 1 AS n FROM (SELECT path_id, seq * 8 + j AS vid FROM paths, range(8) t(j)))
    SELECT f.path_id, CAST(a.n AS BIGINT) AS v1, CAST(b.n AS BIGINT) AS v2, CAST(c.n AS BIGINT) AS v3, CAST(d.n AS BIGINT) AS v4 FROM faces f
    JOIN num a ON a.path_id = f.path_id AND a.vid = f.v1 JOIN num b ON b.path_id = f.path_id AND b.vid = f.v2 JOIN num c ON c.path_id = f.path_id AND c.vid = f.v3 JOIN num d ON d.path_id = f.path_id AND d.vid = f.v4 WHERE least(a.n, b.n, c.n, d.n) >= 0""",
)

# ---------------------------------------------------------------- inference with rule predictors

_add(
    "component_filter",
    on_points(lambda p: predict.component_filter(p, lambda: predict.HeightRule(10.0, RES[2]), RES, SIZE).select("pid", "label")),
    f"WITH {VOTES} SELECT p.pid, coalesce(v.label, 2) AS label FROM points p LEFT JOIN (SELECT pid, CAST(bool_or(above) AS INT) + 1 AS label FROM votes GROUP BY 1) v USING (pid)",
)
_add(
    "component_filter_classes",
    on_points(lambda p: predict.component_filter(p, lambda: predict.HeightRule(10.0, RES[2]), RES, SIZE, 8, False).select("pid", "label")),
    f"WITH {_sql_blocks(SIDES)}, {_sql_voxels()} SELECT p.pid, coalesce(v.label, 7) AS label FROM points p LEFT JOIN (SELECT pid, arg_max(CAST(k >= 20 AS INT), block_id) AS label FROM vox GROUP BY 1) v USING (pid)",
)
_add(
    "tree_detect",
    on_points(lambda p: predict.tree_detect(p, predict.DensityRule, (2.0, 2.0, 2.0), (10, 10, 20)).select("pid", *r6("conf", "radius"))),
    f"""WITH {EXT}, blocks AS (SELECT p.*, CAST(floor((x - x0) / 2.0::DOUBLE / 10) * 1000 + floor((y - y0) / 2.0::DOUBLE / 10) AS BIGINT) AS block_id FROM points p JOIN ext USING (cloud_id)), {_sql_voxels((2.0, 2.0, 2.0), (10, 10, 20))}, c AS (SELECT block_id, voxel, count(*) AS n FROM vox GROUP BY 1, 2)
    SELECT pid, round(n / max(n) OVER (PARTITION BY block_id), 6) AS conf, 1.0::DOUBLE AS radius FROM vox JOIN c USING (block_id, voxel)""",
)
_add(
    "stem_detect",
    on_points(lambda p: predict.stem_detect(p, predict.DensityRule, (2.0, 2.0, 2.0), (10, 10, 20)).select("i", "j", *r6("value", "xmin", "ymin"))),
    f"""WITH {EXT}, blocks AS (SELECT p.*, CAST(floor((x - x0) / 2.0::DOUBLE / 10) * 1000 + floor((y - y0) / 2.0::DOUBLE / 10) AS BIGINT) AS block_id FROM points p JOIN ext USING (cloud_id)), {_sql_voxels((2.0, 2.0, 2.0), (10, 10, 20))},
    c AS (SELECT block_id, i, j, k, count(*) AS n FROM vox GROUP BY ALL), m AS (SELECT block_id, max(n) AS top FROM c GROUP BY 1), lo AS (SELECT block_id, min(x) AS xmin, min(y) AS ymin FROM vox GROUP BY 1)
    SELECT i, j, round(max(n) / any_value(top), 6) AS value, {q6('xmin', 'ymin')} FROM c JOIN m USING (block_id) JOIN lo USING (block_id) GROUP BY block_id, i, j, xmin, ymin""",
)
_add(
    "tree_offset",
    on_both(lambda p, t: predict.tree_offset(p, t, predict.ZeroOffset, (2.0, 2.0, 2.0), (10, 10, 20)).select("pid", "treeoff")),
    f"WITH {_sql_nn(D2XY)}, num AS (SELECT loc_id, row_number() OVER (ORDER BY loc_id) AS treeoff FROM treeloc) SELECT src AS pid, treeoff FROM near JOIN num ON loc_id = dst",
)
_add(
    "crown_offset",
    on_points(lambda p: predict.crown_offset(p, lambda: predict.ZeroOffset(3), (2.0, 2.0, 2.0), (10, 10, 20)).select("pid", "stemoff")),
    f"""WITH {EXT}, own AS (SELECT * FROM points WHERE stemoff > 0), nn AS (SELECT a.pid, arg_min(b.stemoff, ({D2}, b.pid)) AS l FROM points a JOIN own b USING (cloud_id) WHERE a.stemoff <= 0 GROUP BY 1),
    n AS (SELECT p.pid, CASE WHEN stemoff > 0 THEN stemoff ELSE l END AS s, {cell('x - x0', 0.2)} AS i, {cell('y - y0', 0.2)} AS j, {cell('z - z0', 0.2)} AS k FROM points p JOIN ext USING (cloud_id) LEFT JOIN nn ON nn.pid = p.pid)
    SELECT pid, first_value(s) OVER (PARTITION BY i, j, k ORDER BY pid) AS stemoff FROM n""",
)


TILES2 = f"{EXT}, blocks AS (SELECT p.*, CAST(floor((x - x0) / 2.0::DOUBLE / 10) * 1000 + floor((y - y0) / 2.0::DOUBLE / 10) AS BIGINT) AS block_id FROM points p JOIN ext USING (cloud_id)), {_sql_voxels((2.0, 2.0, 2.0), (10, 10, 20))}"
_add(
    "tree_offset_marked",
    on_both(lambda p, t: predict.tree_offset(p, t, lambda: predict.FeatureOffset("has_loc", (3.0, -1.5)), (2.0, 2.0, 2.0), (10, 10, 20)).select("pid", "treeoff")),
    f"""WITH {TILES2}, box AS (SELECT block_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM vox GROUP BY 1),
    marks AS (SELECT DISTINCT block_id, {cell('x - a', 2.0)} AS i, {cell('y - c', 2.0)} AS j, 1.0::DOUBLE AS has FROM treeloc JOIN box ON x > a AND x < b AND y > c AND y < d AND z > e AND z < f),
    moved AS (SELECT v.cloud_id, pid, x + coalesce(has, 0) * 3.0::DOUBLE * 2.0::DOUBLE AS x, y + coalesce(has, 0) * -1.5::DOUBLE * 2.0::DOUBLE AS y FROM vox v LEFT JOIN marks USING (block_id, i, j)),
    near AS (SELECT a.pid, arg_min(b.loc_id, ({D2XY}, b.loc_id)) AS loc_id FROM moved a JOIN treeloc b USING (cloud_id) GROUP BY 1), num AS (SELECT loc_id, row_number() OVER (ORDER BY loc_id) AS treeoff FROM treeloc)
    SELECT p.pid, coalesce(treeoff, 0) AS treeoff FROM points p LEFT JOIN near USING (pid) LEFT JOIN num USING (loc_id)""",
)
_add(
    "crown_offset_marked",
    on_points(lambda p: predict.crown_offset(p, lambda: predict.FeatureOffset("mean_flag", (2.0, -1.0, 0.5)), (2.0, 2.0, 2.0), (10, 10, 20)).select("pid", "stemoff")),
    f"""WITH {TILES2}, flag AS (SELECT block_id, voxel, avg(CAST(stemoff > 0 AS INT)) AS m FROM vox GROUP BY 1, 2),
    moved AS (SELECT cloud_id, pid, x + m * 2.0::DOUBLE * 2.0::DOUBLE AS x, y + m * -1.0::DOUBLE * 2.0::DOUBLE AS y, z + m * 0.5::DOUBLE * 2.0::DOUBLE AS z FROM vox JOIN flag USING (block_id, voxel) WHERE stemoff <= 0),
    own AS (SELECT * FROM points WHERE stemoff > 0), nn AS (SELECT a.pid, arg_min(b.stemoff, ({D2}, b.pid)) AS l FROM moved a JOIN own b USING (cloud_id) GROUP BY 1),
    n AS (SELECT p.pid, CASE WHEN stemoff > 0 THEN stemoff ELSE coalesce(l, 0) END AS s, {cell('x - x0', 0.2)} AS i, {cell('y - y0', 0.2)} AS j, {cell('z - z0', 0.2)} AS k FROM points p JOIN ext USING (cloud_id) LEFT JOIN nn ON nn.pid = p.pid)
    SELECT pid, first_value(s) OVER (PARTITION BY i, j, k ORDER BY pid) AS stemoff FROM n""",
)


def _custom(spark: SparkSession, d: str) -> DataFrame:
    base = models.parse_config(CONFIG)
    rows = [("configured", *base.with_resolution((0.1, 0.0, 0.1)).resolution), ("custom", *base.with_resolution((0.1, 0.2, 0.3)).resolution)]
    return spark.createDataFrame(rows, "case string, rx double, ry double, rz double")


_add("config_hooks", _custom, "SELECT * FROM (VALUES ('configured', 0.5::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE), ('custom', 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE)) t(\"case\", rx, ry, rz)")

# ---------------------------------------------------------------- scalar functions

_add(
    "scalar_functions",
    on_points(
        lambda p: p.withColumns({"s": F.array("conf", "radius", F.lit(0.5))}).select(
            "pid",
            F.round(scalar.norm("x", "y", "z"), 6).alias("norm"),
            F.round(scalar.sigmoid(F.col("conf")), 6).alias("sigmoid"),
            scalar.relu(F.round(F.col("conf") - 0.5, 6)).alias("relu"),
            F.round(F.element_at(scalar.softmax("s"), 1), 6).alias("soft"),
            scalar.argmax("s").cast("int").alias("arg"),
            scalar.clip(F.col("z"), 5.0, 20.0).alias("clip"),
            F.round(scalar.interp(F.col("z"), [0.0, 10.0, 30.0], [0.0, 1.0, 5.0]), 6).alias("interp"),
            F.round(scalar.angle(("x", "y", "z"), ("z", "x", "y")), 5).alias("angle"),
        )
    ),
    """SELECT pid, round(sqrt(x*x+y*y+z*z), 6) AS norm, round(1 / (1 + exp(-conf)), 6) AS sigmoid, greatest(round(conf - 0.5::DOUBLE, 6), 0) AS relu,
    round(exp(conf) / (exp(conf) + exp(radius) + exp(0.5::DOUBLE)), 6) AS soft, CAST(CASE WHEN conf >= radius AND conf >= 0.5 THEN 0 WHEN radius >= 0.5 THEN 1 ELSE 2 END AS INT) AS arg, greatest(least(z, 20::DOUBLE), 5::DOUBLE) AS clip,
    round(CASE WHEN z <= 10 THEN z / 10 ELSE 1 + (z - 10) * 0.2::DOUBLE END, 6) AS interp,
    CASE WHEN x*x+y*y+z*z > 0 THEN round(acos(greatest(least((x*z+y*x+z*y) / (sqrt(x*x+y*y+z*z) * sqrt(z*z+x*x+y*y)), 1), -1)), 5) END AS angle FROM points""",
)
_add(
    "index_functions",
    on_points(lambda p: grid.voxel_key(p, 5.0).withColumn("v", scalar.ravel(("i", "j", "k"), (20, 20, 6))).select("pid", "v", *[c.alias(n) for c, n in zip(scalar.unravel("v", (20, 20, 6)), ("i2", "j2", "k2"), strict=True)])),
    f"SELECT pid, i * 120 + j * 6 + k AS v, i AS i2, j AS j2, k AS k2 FROM (SELECT pid, {cell('x', 5.0)} AS i, {cell('y', 5.0)} AS j, {cell('z', 5.0)} AS k FROM points)",
)

