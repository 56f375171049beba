"""Places and dense ranks without a window over a cloud."""

import numpy as np
from pyspark.sql import functions as F

from pointspark.operators import filters, ranks


def test_numbered_is_the_place_in_the_order(spark):
    rng = np.random.default_rng(0)
    rows = [(str(rng.integers(5)), int(rng.integers(1000)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = {r["i"]: r["at"] for r in ranks.numbered(df, "g", F.desc("v"), "i").collect()}
    want = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert got == {r[2]: at for at, r in enumerate(want)}
    assert ranks.numbered(df.limit(0), "g").count() == 0


def test_rows_alike_get_places_of_their_own(spark):
    df = spark.createDataFrame([(None, 1)] * 50 + [("a", 2)] * 50, "g string, v long").repartition(4)
    got = ranks.numbered(df, "g", "v").collect()
    assert sorted(r["at"] for r in got) == list(range(100)) and {r["at"] for r in got if r["g"] is None} == set(range(50))


def test_dense_ranks_in_each_cloud(spark):
    rows = [("a", v) for v in (5, 5, 9, 7, None)] + [("b", v) for v in (2, 1, 2)] + [(None, 4)]
    df = spark.createDataFrame(rows, "cloud_id string, label long")
    got = {(r["cloud_id"], r["label"]): r["rank"] for r in ranks.dense_ranks(df, "cloud_id", "label").collect()}
    assert got == {("a", 5): 0, ("a", 7): 1, ("a", 9): 2, ("b", 1): 0, ("b", 2): 1, (None, 4): 0}
    plan = filters.compact_labels(df)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(cloud_id" not in plan
