from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from engramlake.llm import knn as K

SCHEMA = "id bigint, embedding array<float>, neighbour string"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(ids, x, k, least):
    x = np.asarray(x, np.float32).astype(np.float64)
    u = x / np.sqrt((x**2).sum(1, keepdims=True))
    out = set()
    for r in range(len(x)):
        s = np.round(u @ u[r], 9)
        c = [j for j in range(len(x)) if j != r and s[j] >= least - 1e-9]
        c.sort(key=lambda j: (-s[j], ids[j]))
        out |= {(ids[r], ids[j]) for j in c[:k]}
    return out


@pytest.mark.parametrize("block_rows", [8192, 32])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 16))
    x = (centre[rng.integers(0, 60, 700)] + 0.2 * rng.normal(size=(700, 16))).astype(np.float32)
    ids = list(range(1000, 1700))
    got = {(r.id, r.neighbour) for r in K.neighbours(frame(spark, ids, x), "id", "embedding", dim=16, list_rows=32, block_rows=block_rows).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    a, b = [1.0, 0, 0, 0], [0.99, 0.1, 0, 0]
    rows = [(k, a) for k in range(1, 10)] + [(20, b), (20, b), (30, None), (31, []), (32, [1.0]), (33, [float("nan"), 1, 1, 1]), (34, [0.0] * 4), (35, [float("inf"), 0, 0, 0]), (None, a)]
    got = K.neighbours(frame(spark, [i for i, _ in rows], [v for _, v in rows]), "id", "embedding", dim=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.neighbour)
    assert sorted(by[1]) == [2, 3, 4, 5, 6] and sorted(by[9]) == [1, 2, 3, 4, 5] and sorted(by[20]) == [1, 2, 3, 4, 5]
    assert set(by) == {*range(1, 10), 20}
    pairs = [tuple(r) for r in K.neighbour_pairs(K.neighbours(frame(spark, [1, 2], [a, b]), "id", "embedding", dim=4)).collect()]
    assert pairs == [(1, 2)]


def test_empty(spark):
    assert K.neighbours(frame(spark, [], []), "id", "embedding").collect() == []


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    x = K.unit(rng.normal(size=(6000, 64)))
    c = K.balanced_centroids(x, 200)
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert sizes.max() < 12 * sizes.mean()
    even = K.even_centroids(x, 200)
    sizes = np.bincount((x @ even.T).argmax(1), minlength=len(even))
    assert sizes.max() < 3 * sizes.mean()
    g = K.CentroidGraph(c)
    node, sim = g.search(x[:500])
    exact = x[:500] @ c.T
    assert (exact.argmax(1) == node[:, 0]).mean() > 0.9
    assert np.allclose(sim[:, 0], exact[np.arange(500), node[:, 0]], atol=1e-5)
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in node)


def _clusters(n=700):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(60, 16))
    return list(range(1000, 1000 + n)), (centre[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 16))).astype(np.float32)


def test_cells_are_cut_into_lists_of_their_own(spark):
    ids, x = _clusters(1500)
    got = {(r.id, r.neighbour) for r in K.neighbours(frame(spark, ids, x), "id", "embedding", dim=16, sample_rows=64, list_rows=32, block_rows=64).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_exact_neighbours(spark):
    ids, x = _clusters()
    df = frame(spark, [*ids, 5000, 5001], [*x, x[0], x[20]])
    got = {(r.id, r.neighbour) for r in K.exact_neighbours(df, df.where("id % 20 = 0"), "id", "embedding", dim=16, query_rows=16).collect()}
    want = {p for p in brute([*ids, 5000, 5001], np.concatenate([x, x[[0, 20]]]), 5, 0.9) if p[0] % 20 == 0}
    assert got == want
    assert K.exact_neighbours(df.limit(0), df.limit(0), "id", "embedding", dim=16).collect() == []


def test_the_same_rows_in_other_files_give_the_same_result(spark):
    ids, x = _clusters()
    order = np.random.default_rng(3).permutation(len(ids))
    a = frame(spark, ids, x)
    b = frame(spark, [ids[k] for k in order], x[order]).repartition(7)
    how = dict(dim=16, sample_rows=100, list_rows=32)
    rows = [sorted((r.id, r.neighbour) for r in K.neighbours(d, "id", "embedding", **how).collect()) for d in (a, b)]
    assert rows[0] == rows[1]


def test_walks_start_at_few_centroids():
    g = K.CentroidGraph(K.unit(np.random.default_rng(4).normal(size=(3000, 16))))
    assert len(g.layers) > 1 and len(g.layers[-1][0]) <= max(16, 3000**0.5)


def test_the_driver_does_not_fit(spark, monkeypatch):
    ids, x = _clusters()
    want = {tuple(r) for r in K.neighbours(frame(spark, ids, x), "id", "embedding", dim=16, k=3, least=0.8, list_rows=50).collect()}
    monkeypatch.setattr(K.CentroidGraph, "search", None)  # workers have modules of their own
    monkeypatch.setattr(K, "_kmeans", None)
    got = {tuple(r) for r in K.neighbours(frame(spark, ids, x), "id", "embedding", dim=16, k=3, least=0.8, list_rows=50).collect()}
    assert got == want and want


def test_linking_many_centroids_holds_bounded_products():
    c = K.unit(np.random.default_rng(3).normal(size=(8000, 16)))
    tracemalloc.start()
    K.CentroidGraph(c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 1,024 rows at a time held 131 MB
