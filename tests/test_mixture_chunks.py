"""Mixtures fitted in one task and in chunks are those of the plain version, component by component."""

import numpy as np
from test_mixtures import plain_split
from test_operators import cloud, values

from pointspark.operators import superpoints


def test_chunks_and_whole_components_equal_the_plain_version(spark):
    rng = np.random.default_rng(3)
    parts, seeds, want = [], [], []
    for label, (n, k) in enumerate(((90, 2), (160, 3), (240, 5))):
        at = rng.uniform(-4, 4, (k, 3)) + 30 * label
        x = at[rng.integers(0, k, n)] + rng.normal(0, 1, (n, 3)) * [1.5, 0.3, 0.7]
        parts.append(x)
        seeds += [("c", label, 10 * label + i, *map(float, b)) for i, b in enumerate(at)]
        want += plain_split(x, at)[0].tolist()
    p = cloud(spark, np.concatenate(parts), label=("long", [i for i, x in enumerate(parts) for _ in x]))
    bases = spark.createDataFrame(seeds, "cloud_id string, label long, loc_id long, x double, y double, z double")
    for whole in (10_000_000, 400):  # all whole; some in chunks
        got = dict(values(superpoints.mixture_split(p, bases, whole=whole), "pid", "part"))
        assert [got[i] for i in range(len(want))] == want


def test_small_components_need_no_rounds(spark, monkeypatch):
    written, real = [], superpoints.materialize
    monkeypatch.setattr(superpoints, "materialize", lambda df, name: written.append(name) or real(df, name))
    p = cloud(spark, np.random.default_rng(0).normal(size=(40, 3)), label=("long", [0] * 40))
    bases = spark.createDataFrame([("c", 0, i, float(i), 0.0, 0.0) for i in range(3)], "cloud_id string, label long, loc_id long, x double, y double, z double")
    assert superpoints.mixture_split(p, bases).count() == 40
    assert "sums" not in written and "forms" not in written
