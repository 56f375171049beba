"""Both directions of edges come from one search."""

import pytest

from pointspark.operators import graph, sets, spatial


@pytest.mark.parametrize("step", [graph.symmetrize, sets.union_reverse_pairs])
def test_searched_once(spark, step):
    p = spark.range(50).selectExpr("'a' AS cloud_id", "id AS pid", "double(id) AS x", "double(id % 3) AS y", "0D AS z")
    out = step(spatial.knn_bounded(p, 2, 5.0).select("cloud_id", "src", "dst", "dist").withColumnRenamed("dist", "w"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    assert {(r["dst"], r["src"]) for r in out.collect()} == {(r["src"], r["dst"]) for r in out.collect()}
