from __future__ import annotations

import random

import pytest

from engramlake.operators.hierarchy import all_descendants, cycle_members, descendants, hierarchy, parent_edges, resolve_children

SCHEMA = "id bigint, parent_id bigint, level int, child string"


def brute(pairs):
    up = {}
    for i, p in pairs:
        if i is not None:
            up[i] = min(x for x in (p, up.get(i)) if x is not None) if i in up and (p is not None or up[i] is not None) else p
    out = {}
    for i in up:
        path, at = [i], i
        while up[at] is not None and up[at] in up and up[at] not in path:
            at = up[at]
            path.append(at)
        looped = up[at] in up if up[at] is not None else False
        out[i] = (-1, -1, "") if looped else (at, len(path) - 1, "/".join(map(str, reversed(path))))
    return out


def resolve(spark, pairs, local_edges):
    df = spark.createDataFrame([(i, p, 0, "x") for i, p in pairs], SCHEMA)
    return {r.id: (r.root_id, r.depth, r.path, r.n_below) for r in hierarchy(df, local_edges=local_edges).collect()}


@pytest.mark.parametrize("local_edges", [0, 3, 10_000])
def test_against_brute_force(spark, local_edges):
    rng = random.Random(local_edges)
    n = 60
    pairs = [(i, rng.choice([None, 0, -1, 999, rng.randrange(1, n)])) for i in range(1, n)]
    pairs += pairs[:7]  # delivered twice
    pairs += [(101, 102), (102, 103), (103, 101), (104, 101)]  # a loop and a node below it
    pairs += [(200 + k, 199 + k) for k in range(1, 25)] + [(200, None)]  # a chain
    pairs += [(300 + k, 300) for k in range(1, 20)] + [(300, 0)]  # a wide parent
    pairs += [(None, 5), (None, None), (400, 400)]  # no id; its own parent
    got = resolve(spark, pairs, local_edges)
    want = brute(pairs)
    assert {k: v[:3] for k, v in got.items()} == want
    below = {k: 0 for k in want}
    for root, _, path in want.values():
        if root != -1:
            for a in path.split("/")[:-1]:
                below[int(a)] += 1
    assert all(got[k][3] == below[k] for k in want if want[k][0] != -1)
    assert got[101][3] == got[102][3] == got[400][3] == -1 and got[104][3] == 0


def test_descendants_and_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id bigint, parent_id bigint")
    _, edges = parent_edges(df)
    nodes = resolve_children(edges)
    assert {tuple(r) for r in descendants(nodes).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert {tuple(r) for r in cycle_members(edges, nodes).collect()} == {(8, 9), (9, 8)}


def test_empty_and_only_roots(spark):
    empty = spark.createDataFrame([], "id bigint, parent_id bigint")
    assert hierarchy(empty).collect() == []
    roots = spark.createDataFrame([(1, None), (2, 77)], "id bigint, parent_id bigint")
    assert {(r.id, r.root_id, r.depth) for r in hierarchy(roots).collect()} == {(1, 1, 0), (2, 2, 0)}


def test_only_cycles_beyond_the_local_bound(spark):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3)], "id bigint, parent_id bigint")
    assert all(r.root_id == -1 and r.path == "" for r in hierarchy(df, local_edges=1).collect())


@pytest.mark.parametrize("local_edges", [0, 10_000])
def test_all_descendants_below_loops(spark, local_edges):
    pairs = [(1, None), (2, 1), (11, 12), (12, 13), (13, 11), (20, 11), (21, 20), (22, 21), (30, 30), (31, 30)]
    _, edges = parent_edges(spark.createDataFrame(pairs, "id bigint, parent_id bigint"))
    up = {i: p for i, p in pairs if p}
    want = {(1, 2, 1)}
    for i in (20, 21, 22, 31):
        at, seen = up[i], []
        while at not in seen:
            seen.append(at)
            want.add((at, i, len(seen)))
            at = up[at]
    got = [tuple(r) for r in all_descendants(edges, local_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_deep_residue_is_doubled(spark):
    """A chain of 5,000, a loop with a chain beneath it and another loop, far beyond what one task may peel."""
    pairs = [(k, k - 1) for k in range(1, 5001)]  # 0 has no row: 1 is a root
    pairs += [(9001, 9002), (9002, 9003), (9003, 9001), (9100, 9001)] + [(9100 + k, 9099 + k) for k in range(1, 300)] + [(9900, 9900)]
    got = resolve(spark, pairs, 10)
    for k in (1, 2, 17, 2500, 5000):
        assert got[k] == (1, k - 1, "/".join(map(str, range(1, k + 1))), 5000 - k)
    assert all(got[k] == (-1, -1, "", -1) for k in (9001, 9002, 9003, 9900))
    assert all(got[9100 + k] == (-1, -1, "", 299 - k) for k in range(300))
