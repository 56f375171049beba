"""A LAS file is written in pieces."""

from pointspark.sources import las


def test_pieces(spark, tmp_path, monkeypatch):
    pieces, plain = {}, las.materialize
    monkeypatch.setattr(las, "AT_ONCE", 100)
    monkeypatch.setattr(las, "materialize", lambda df, name: pieces.setdefault(name, plain(df, name)))
    monkeypatch.setattr(las, "discard", lambda *frames: None)
    p = spark.range(3000).selectExpr("concat('c', id % 3) AS cloud_id", "(id * 7) % 3000 AS pid", "id / 8D - 100 AS x", "-id / 4D AS y", "id % 10 / 2D AS z", "int(id % 500) AS cls")
    las.write_las(p, f"{tmp_path}/las", "cls", points_per_file=1 << 40)
    assert sorted(f.name for f in (tmp_path / "las").iterdir()) == ["c0_0.las", "c1_0.las", "c2_0.las"]
    assert pieces["las-pieces"].count() >= 30
    got = las.read_las(spark, f"{tmp_path}/las").toPandas().sort_values(["cloud_id", "pid"])
    want = p.toPandas().sort_values(["cloud_id", "pid"])
    assert got["pid"].tolist() == list(range(1000)) * 3
    assert (got[["x", "y", "z"]].to_numpy() - want[["x", "y", "z"]].to_numpy()).__abs__().max() < 0.001
    assert got["label"].tolist() == want["cls"].tolist()


def test_files_of_few_points(spark, tmp_path):
    p = spark.range(1000).selectExpr("'c' AS cloud_id", "id AS pid", "double(id) AS x", "0D AS y", "0D AS z")
    las.write_las(p, f"{tmp_path}/las", points_per_file=300)
    got = las.read_las(spark, f"{tmp_path}/las").groupBy("cloud_id").count().collect()
    assert sorted((r["cloud_id"], r["count"]) for r in got) == [("c_0", 300), ("c_1", 300), ("c_2", 300), ("c_3", 100)]
