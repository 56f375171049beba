"""Responsibilities that are 0, and points and bases at one place, cost no time and change no result."""

import numpy as np
from test_operators import cloud, values

from pointspark.operators import superpoints


def dense(x, const, mean, form):
    d = x[:, None] - mean
    lp = const - np.einsum("nki,kij,nkj->nk", d, form, d) / 2
    lse = np.logaddexp.reduce(lp, axis=1)
    return np.exp(lp - lse[:, None]), lp, lse


def test_sums_equal_the_dense_ones(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (60, 3)) + [20.0 * i, 0, 0] for i in range(20)])
    x = np.concatenate((x, x[:300]))  # points at one place
    mean = np.repeat(np.arange(20.0), 2)[:, None] * [20.0, 0, 0] + rng.normal(0, 0.2, (40, 3))
    half = rng.normal(0, 2, (40, 3, 3))
    form = half @ half.transpose(0, 2, 1) + np.eye(3)
    const = rng.normal(0, 1, 40)
    const[7] = -5000.0  # a part that nothing belongs to
    r, lp, lse = dense(x, const, mean, form)
    monkeypatch.setattr(superpoints, "BLOCK", 64)
    blocks = superpoints.PointBlocks(x)
    count, first, second, bound, taken = superpoints.mixture_sums(blocks, const, mean, form)
    assert np.allclose(count, r.sum(axis=0), rtol=1e-9, atol=1e-300)
    assert np.allclose(first, r.T @ x, rtol=1e-9, atol=1e-9)
    assert np.allclose(second, np.einsum("nk,ni,nj->kij", r, x, x), rtol=1e-9, atol=1e-7)
    assert np.isclose(bound.sum(), lse.sum(), rtol=1e-12)
    assert (superpoints.mixture_parts(blocks, const, mean, form) == lp.argmax(axis=1)).all()
    assert count[7] == 0 and taken < r.size / 3


def test_bases_at_one_place_are_fitted_once():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 3)) * [3, 1, 1]
    seeds = np.array([[-3.0, 0, 0], [0, 0, 0], [3, 0, 0]])
    times = np.array([1.0, 3.0, 2.0])
    spread, blocks = x.T @ x / len(x), superpoints.PointBlocks(x)
    once = superpoints.mixture_sums(blocks, *superpoints.nearest_forms(seeds), times)
    every = superpoints.mixture_sums(blocks, *superpoints.nearest_forms(np.repeat(seeds, [1, 3, 2], axis=0)))
    for _ in range(3):
        assert np.allclose(np.repeat(once[0], [1, 3, 2]), every[0], rtol=1e-9) and np.isclose(once[3].sum(), every[3].sum())
        a, b = superpoints.mixture_step(*once[:3], spread, times), superpoints.mixture_step(*every[:3], spread)
        assert np.isclose(a[3], b[3])
        once, every = superpoints.mixture_sums(blocks, *a[:3], times), superpoints.mixture_sums(blocks, *b[:3])


def test_chunks_equal_whole_components_with_repeated_places(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (40, 3)) * [1.5, 0.3, 0.7] + [6.0 * i, 0, 0] for i in range(3)])
    x = np.concatenate((x, x[:50]))
    p = cloud(spark, x, label=("long", [0] * len(x)))
    at = [(0.0, 0.0, 0.0), (6.0, 0.0, 0.0), (6.0, 0.0, 0.0), (12.0, 0.0, 0.0)]
    bases = spark.createDataFrame([("c", 0, i, *b) for i, b in enumerate(at)], "cloud_id string, label long, loc_id long, x double, y double, z double")
    # in one task; begun in chunks and ended in one; in chunks to the end
    got = [dict(values(superpoints.mixture_split(p, bases, whole=n), "pid", "part")) for n in (10_000, 450, 100)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(x)
    assert set(got[0].values()) == {0, 1, 3}  # of parts alike the first


def test_parts_without_points_are_one_row():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (300, 3))
    count = np.array([200.0, 0, 100, 0, 0])
    first = count[:, None] * rng.normal(0, 0.5, (5, 3))
    second = count[:, None, None] * np.eye(3) * 2 * np.array([1.0, 0, 1, 0, 0])[:, None, None]
    spread = x.T @ x / len(x)
    parts, times, *sums = superpoints.without_gone(np.arange(5), np.ones(5), count, first, second)
    assert parts.tolist() == [0, 1, 2] and times.tolist() == [1, 3, 1]
    few, every = superpoints.mixture_step(*sums, spread, times), superpoints.mixture_step(count, first, second, spread)
    assert np.allclose(few[0], every[0][:3]) and np.allclose(few[2], every[2][:3]) and np.isclose(few[3], every[3])
    blocks = superpoints.PointBlocks(x)
    a, b = superpoints.mixture_sums(blocks, *few[:3], times), superpoints.mixture_sums(blocks, *every[:3])
    assert np.allclose(a[0], b[0][:3]) and np.isclose(a[3].sum(), b[3].sum())
