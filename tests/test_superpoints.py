"""Superpoints by contraction: the same regions whatever the size of a task, and energies within 5 % of a single greedy order."""

import numpy as np
import pytest
from test_operators import cloud, values

from pointspark.operators import superpoints


def graph(n, seed, k=5):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3)) * [4, 4, 1]
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1 : k + 1]
    return x, np.array([(i, j) for i in range(n) for j in near[i]])


def energy(x, edges, label, strength):
    at = np.unique(label, return_inverse=True)[1]
    mean = np.stack([np.bincount(at, x[:, c]) / np.bincount(at) for c in range(3)], axis=1)
    return ((x - mean[at]) ** 2).sum() + strength * (at[edges[:, 0]] != at[edges[:, 1]]).sum()


@pytest.mark.parametrize(("n", "strength"), [(200, 0.05), (1000, 0.02), (2000, 0.5), (500, 1e6), (300, 0.0)])
def test_contraction_lowers_the_energy(n, strength):
    x, edges = graph(n, n)
    got, greedy = superpoints.contract(x, edges, np.ones(len(edges)), strength), superpoints.region_fusion(x, edges, np.ones(len(edges)), strength)
    assert energy(x, edges, got, strength) <= energy(x, edges, np.arange(n), strength)
    assert energy(x, edges, got, strength) <= 1.05 * energy(x, edges, greedy, strength)
    assert (got <= np.arange(n)).all() and (got[got] == got).all()
    if strength == 0.0:
        assert (got == np.arange(n)).all()
    else:  # no two regions are left whose merger would lower it
        last = energy(x, edges, got, strength)
        for a, b in {tuple(sorted(p)) for p in got[edges] if p[0] != p[1]}:
            assert energy(x, edges, np.where(got == b, a, got), strength) >= last - 1e-9


def test_contraction_takes_pairs_that_pick_each_other():
    """On a line of gaps 1, 2, 1.5 the outer pairs merge first, then what is left."""
    x = np.array([[0.0, 0, 0], [1, 0, 0], [3, 0, 0], [4.5, 0, 0]])
    edges, weights = np.array([(0, 1), (1, 2), (2, 3)]), np.ones(3)
    assert superpoints.contract(x, edges, weights, 2.0).tolist() == [0, 0, 2, 2]
    assert superpoints.contract(x, edges, weights, 1.0).tolist() == [0, 0, 2, 3]
    assert superpoints.contract(x, edges, weights, 100.0).tolist() == [0, 0, 0, 0]


def test_results_do_not_depend_on_the_size_of_a_task(spark):
    x, _ = graph(250, 7)
    p = cloud(spark, np.concatenate((x, x[:30] + 50)))
    one, joins = (dict(values(superpoints.superpoints(p, 1e-4, 5, 0.2, tile_points=t), "pid", "init_segs")) for t in (10**6, 20))
    assert one == joins and 10 < len(set(one.values())) < 200
