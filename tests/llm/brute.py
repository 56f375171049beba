"""Plain versions of the operators, over Python lists."""

from collections import defaultdict

import numpy as np


def shingles(text, k=5):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def near_copies(docs, percent=75):
    """Component of each document, by comparing all that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def top_k(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.floor(256 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    out = []
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        own = [(-int(score[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q]]
        out += [(int(ids[q]), r + 1, i, -s) for r, (s, i) in enumerate(sorted(own)[:k])]
    return out
