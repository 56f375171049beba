"""Mixture split: against a plain variational mixture, on crossing stems, and its bound."""

import numpy as np
import pytest
from test_operators import cloud, values

from pointspark.operators import superpoints


def crossing(n=300, seed=0):
    """Two long thin stems that lean across each other."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 1, n)
    a = np.column_stack((4 * t - 2, 0.2 + 0 * t, 6 * t)) + rng.normal(0, 0.05, (n, 3))
    b = np.column_stack((2 - 4 * t, -0.2 + 0 * t, 6 * t)) + rng.normal(0, 0.05, (n, 3))
    return np.concatenate((a, b))


def plain_split(x, seeds, tolerance=1e-4):
    x, seeds = x - x.mean(axis=0), seeds - x.mean(axis=0)
    spread = x.T @ x / len(x) + 1e-6 * np.eye(3)
    r = np.eye(len(seeds))[((x[:, None] - seeds) ** 2).sum(axis=2).argmin(axis=1)]
    bounds = []
    while True:
        const, mean, form, apart = superpoints.mixture_step(r.sum(axis=0), r.T @ x, np.einsum("nk,ni,nj->kij", r, x, x), spread)
        d = x[:, None] - mean
        lp = const - np.einsum("nki,kij,nkj->nk", d, form, d) / 2
        lse = np.logaddexp.reduce(lp, axis=1)
        r = np.exp(lp - lse[:, None])
        bounds.append(lse.sum() - apart)
        if len(bounds) > 1 and (bounds[-1] - bounds[-2]) / len(x) <= tolerance:
            return lp.argmax(axis=1), bounds


def test_the_bound_never_falls():
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(120, 3)) + np.repeat(np.eye(3) * 3, 40, axis=0)
        _, bounds = plain_split(x, np.eye(3), tolerance=1e-9)
        assert (np.diff(bounds) > -1e-7).all() and len(bounds) > 2


def test_digamma():
    assert superpoints.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert superpoints.digamma(0.25) == pytest.approx(-4.227453533376265, abs=1e-11)


def test_crossing_stems(spark):
    x = crossing()
    other = np.random.default_rng(5).normal(size=(60, 3)) + 40
    p = cloud(spark, np.concatenate((x, other)), label=("long", [0] * 600 + [7] * 60))
    seeds = np.array([[-2.0, 0.2, 0.0], [2.0, -0.2, 0.0]])
    rows = [("c", 0, 1, *map(float, seeds[0])), ("c", 0, 2, *map(float, seeds[1])), ("c", 7, 3, 40.0, 40.0, 40.0)]
    bases = spark.createDataFrame(rows, "cloud_id string, label long, loc_id long, x double, y double, z double")
    got = dict(values(superpoints.mixture_split(p, bases), "pid", "part"))
    assert set(got) == set(range(600))  # the component of one base is not split
    want, _ = plain_split(x, seeds)
    assert [got[i] for i in range(600)] == want.tolist()
    share = np.mean([got[i] == (i >= 300) for i in range(600)])
    right = max(share, 1 - share)  # either part may follow either stem
    near = ((x[:, None] - np.array([x[want == k].mean(axis=0) for k in (0, 1)])) ** 2).sum(axis=2).argmin(axis=1)
    by_centre = np.mean(near == (np.arange(600) >= 300))
    assert right > 0.99 and max(by_centre, 1 - by_centre) < 0.95


def test_nothing_to_split(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1)], label=("long", [0, 0]))
    bases = spark.createDataFrame([("c", 0, 1, 0.0, 0.0, 0.0)], "cloud_id string, label long, loc_id long, x double, y double, z double")
    assert superpoints.mixture_split(p, bases).count() == 0
