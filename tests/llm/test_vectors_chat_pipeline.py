import math
from collections import Counter

import brute
import numpy as np
import pytest

from pointspark.llm import queries as q
from pointspark.llm.op4_chat import preference_pairs
from pointspark.llm.op7_topk import SortedLists, top_k
from pointspark.llm.op8_embedding_dedup import near_duplicates


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0, 2.0]), (50, [1.0, 0.0, 2.0]), (50, [1.0, 0.0, 2.0]), (1, None), (2, [1.0, None, 0.0]), (3, [float("nan"), 0.0, 1.0]),
        (4, [float("inf"), 0.0, 1.0]), (5, [0.0, 0.0, 0.0]), (6, []), (7, [1.0, 0.0]), (100, [2.0, 0.0]), (None, [1.0, 0.0, 2.0]), (8, [-0.0, 0.0, 3.0]), (9, [0.0, 0.0, 3.5]), (150, [-1.0, -0.5, -2.0]),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")


def rows_of(spark, sf):
    return [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def test_op7_equals_brute_force(spark, sf):
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in q.op7_exact_topk(spark, sf).collect())
    assert got == sorted(brute.top_k(rows_of(spark, sf)))


def test_op7_small_blocks_change_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, k=3, every=25, block_rows=60, query_rows=4).collect())
    assert got == sorted(brute.top_k(rows_of(spark, sf), 3, 25))


def test_op7_stops_early():
    """One dimension dominates: the lists are read only as far as the bound demands."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(5000, 4)) * [1000, 1, 1, 1])
    lists = SortedLists(np.arange(5000), x)
    counted = []
    lists.x = type("Counted", (np.ndarray,), {"__getitem__": lambda s, k: (counted.append(np.size(k)) if isinstance(k, np.ndarray) else None, np.ndarray.__getitem__(s, k))[1]}).__call__(x.shape, buffer=x.copy())
    query = np.array([3.0, 1.0, -1.0, 0.0])
    ids, scores = lists.top(-1, query, 5)
    want = sorted(((-int(v), i) for i, v in enumerate(x @ query)))[:5]
    assert list(zip(-scores, ids, strict=True)) == want
    assert sum(counted) < 2500


def test_op7_odd_rows(odd_vectors):
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(odd_vectors).collect()}
    own = [(k, v) for k, v in got.items() if k[0] == 0]
    assert got[0, 1] == (8, 512 * 768) or got[0, 1][1] >= own[-1][1][1]
    assert {v[0] for k, v in own} == {50, 8, 9, 5, 150} or {v[0] for k, v in own} <= {50, 8, 9, 5, 150}
    assert {v[0] for k, v in got.items() if k[0] == 100} == {7}
    assert not any(v[0] in (None, 1, 2, 3, 4) for v in got.values())
    assert [got[50, r][0] for r in (1, 2)] == [9, 8]
    assert top_k(odd_vectors.limit(0)).count() == 0


def test_op7_wide_empty_and_repeated(spark):
    """Values beyond two bytes, empty vectors, and one identifier on a third of all rows."""
    rng = np.random.default_rng(4)
    rows = [(int(i), v.tolist()) for i, v in zip([*range(60), *[50] * 30], rng.normal(size=(90, 3)) * [1, 500, 1], strict=True)]
    got = top_k(spark.createDataFrame([*rows, (100, []), (101, [])], "vec_id long, embedding array<double>"), slice_rows=4, block_rows=16)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = [(100, 1, 101, 0)]
    for q_id in (0, 50):
        best = sorted({(-int(s), i, at, j) for j, w in enumerate(x) if rows[j][0] == q_id for at, s in enumerate(x @ w) if (i := rows[at][0]) != q_id})
        want += [(q_id, r + 1, i, -s) for r, (s, i) in enumerate([(s, i) for s, i, _, _ in best][:5])]
    assert got == sorted(want)


def links_of(rows, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    comp = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    return {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 20, "block_rows": 16}, {"threshold": 0.5, "cell_rows": 30, "block_rows": 10, "spread": 8.0}])
def test_op8_equals_brute_force(spark, sf, options):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, **options).collect()}
    assert got == links_of(rows_of(spark, sf), options.get("threshold", 0.9))


def test_op8_recall_at_the_threshold(spark):
    """Pairs all near the threshold, in random directions and many cells: the hardest case for visits."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 32))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.sqrt((e * e).sum(axis=1, keepdims=True))
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * e
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((x, y)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"bin_rows": 50, "block_rows": 16}, {"max_cells": 3, "bin_rows": 64}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, cell_rows=40, **options).collect()}
        assert got == links_of(rows)  # both sides of every pair count it
        assert sum(n for n, _, _ in got.values()) == 800


def test_op8_one_identifier_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "b"), (2, [1.0, 0.01, 0.0], "c"), (3, [0.0, 1.0, 0.01], "d"), (4, [0.0, 0.0, 1.0], "e"), (4, [0.0, 0.0, 1.0], "f"), (0, [0.0, 0.01, 1.0], "g"), (4, [1.0, 0.0, 0.02], "h")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 2, 0, False), (4, 2, 0, False), (4, 2, 1, False)]


@pytest.mark.parametrize("options", [{}, {"bin_rows": 90, "block_rows": 32}])
def test_op8_loses_no_link_of_few_dimensions(spark, options):
    """Neighbours differ along 3 of 64 dimensions, so their difference may lie along the way to another centroid."""
    rng = np.random.default_rng(8)
    x = np.zeros((600, 64))
    x[:, :3] = rng.normal(size=(600, 3))
    x[::7] *= 1 / 3  # not all of them exact in single precision
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, threshold=0.98, cell_rows=20, **options).collect()}
    assert got == links_of(rows, 0.98)


def test_op8_odd_rows(odd_vectors):
    rows = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(odd_vectors).collect()]
    assert len(rows) == 15
    c = Counter(rows)
    assert c[(50, 2, 0, False)] == 2 and c[(0, 2, 0, True)] == 1 and c[(None, 0, None, False)] == 1
    assert c[(8, 1, 8, True)] == 1 and c[(9, 1, 8, False)] == 1 and c[(7, 1, 7, True)] == 1 and c[(100, 1, 7, False)] == 1
    assert all(c[(i, 0, i, True)] == 1 for i in (1, 2, 3, 4, 5, 6, 150))
    assert near_duplicates(odd_vectors.limit(0)).count() == 0


def plain_pair(c, r):
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def render(turns):
        text, spans = "", []
        for role, body in turns:
            text += "<|im_start|>" + (role or "") + "\n"
            start = len(text)
            text += (body or "") + "<|im_end|>\n"
            if role == "assistant":
                spans.append((start, len(text) - 1))
        return text, spans

    return n, render(c[:n])[0], *render(c[n:]), *render(r[n:])


def test_op4_equals_brute_force(spark, sf):
    turns = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"], r["role"], r["text"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    answers = {c: [t for role, t in ts if role == "assistant"][-1] for c, ts in turns.items() if any(role == "assistant" for role, _ in ts)}
    got = q.op4_preference_format(spark, sf).collect()
    assert sorted(r["pair_id"] for r in got) == sorted(turns)
    for r in got:
        own = turns[r["pair_id"]]
        other = list(own)
        last = max((i for i, t in enumerate(own) if t[0] == "assistant"), default=None)
        if last is not None:
            other[last] = ("assistant", answers.get(r["pair_id"] + 1, answers[min(answers)]))
        n, prompt, chosen, cm, rejected, rm = plain_pair(own, other)
        assert (r["n_common"], r["prompt"], r["chosen"], r["rejected"]) == (n, prompt, chosen, rejected)
        assert r["chosen_mask"] == ",".join(f"{a}-{b}" for a, b in cm) and r["rejected_mask"] == ",".join(f"{a}-{b}" for a, b in rm)
    assert sum(0 < r["n_common"] < r["n_chosen"] for r in got) > 0.7 * len(got)


def test_op4_prefixes_masks_and_odd_rows(spark):
    rows = [
        (1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes 😀"), (1, False, 1, "assistant", "no"), (1, False, 0, "user", "hi"), (1, False, 2, "user", None),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"),
        (3, True, 0, None, None), (3, True, 0, "user", "a"), (3, True, 0, "user", "a"),
        (4, False, None, "assistant", ""), (4, False, 5, "assistant", "z"),
        (None, True, 0, "user", "x"), (5, None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "pair_id long, chosen boolean, turn long, role string, text string, prompt string")
    by = {r["pair_id"]: r for r in preference_pairs(df).collect()}
    assert set(by) == {1, 2, 3, 4}
    r = by[1]
    assert r["n_common"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    (m,) = r["chosen_mask"]
    assert r["chosen"][m["start"] : m["end"]] == "yes 😀<|im_end|>"
    assert [r["rejected"][m["start"] : m["end"]] for m in r["rejected_mask"]] == ["no<|im_end|>"]
    assert (by[2]["chosen"], by[2]["rejected"], by[2]["n_common"]) == ("", "", 1)
    assert by[3]["n_chosen"] == 3 and by[3]["n_rejected"] == 0 and by[3]["rejected"] == "" and by[3]["prompt"] == ""
    assert len(by[4]["rejected_mask"]) == 2
    assert preference_pairs(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in p.STAGES:
        out = p.materialize(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert out.columns == columns
            ids.append([r["doc_id"] for r in out.select("doc_id").collect()])
            docs = out
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    assert len(ids[0]) == len(ids[1]) == 200  # every document has letters
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, comp = brute.near_copies([(d, t) for d, t in dict(texts).items()])
    assert all(comp[d] == d for d in comp)  # one of each group
    assert max(Counter(ids[3]).values()) <= 2
    assert math.isclose(out.agg({"length": "sum"}).first()[0], sum(r["length"] for r in out.collect()))
    assert {r["doc_id"] for r in out.collect()} == set(ids[3])


def test_pipeline_stages_on_odd_rows(spark, odd, none, sf):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, sf)
            assert name == "best_fit_packing" or out.columns == docs.columns
            assert out.count() == 0 if docs is none else out.count() > 0
