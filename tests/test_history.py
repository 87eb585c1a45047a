from __future__ import annotations

import random

import pytest

from engramlake.operators.history import attribute_history

SCHEMA = "id bigint, subject string, relation string, object string, valid_from double, valid_until double, created_at double, until string"
NAN = float("nan")


def run(spark, rows, slice_s=1e6):
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    got = attribute_history(df, slice_s=slice_s).drop("change").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def brute(rows):
    best = {}
    for i, s, r, o, a, b, c in rows:
        start = c if a is None or a != a else a
        if r not in ("name_is", "works_at", "located_in", "currently_doing") or start is None:
            continue
        k = (s, r, start)
        if k not in best or ((c if c is not None else -1e18), i) > best[k][0]:
            best[k] = (((c if c is not None else -1e18), i), o, b)
    out = set()
    for key in {(s, r) for s, r, _ in best}:
        at = sorted(k[2] for k in best if k[:2] == key)
        periods = []
        for n, t in enumerate(at):
            _, o, b = best[(*key, t)]
            nxt = at[n + 1] if n + 1 < len(at) else None
            end = b if b is not None and b == b and b > t and (nxt is None or b < nxt) else nxt
            if periods and periods[-1][0] == o and periods[-1][2] == t:
                periods[-1][2] = end
            else:
                periods.append([o, t, end])
        out |= {(*key, o, int(a // 1), -1 if e is None else int(e // 1)) for o, a, e in periods}
    return out


@pytest.mark.parametrize("slice_s", [3.0, 1e9])
def test_against_brute_force(spark, slice_s):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        t = rng.choice([None, NAN, float(rng.randrange(60)), rng.randrange(60) + 0.5])
        rows.append((i, rng.choice(["a", "b", None]), rng.choice(["name_is", "works_at", "likes"]), rng.choice(["x", "X", None, "y"]), t, rng.choice([None, None, float(rng.randrange(70))]), float(rng.randrange(60))))
    rows += rows[:20]
    assert run(spark, rows, slice_s) == brute(rows)


def test_gaps_merges_and_corrections(spark):
    rows = [
        (1, "s", "works_at", "A", 10.0, 20.0, 10.0),  # ends before the next start
        (2, "s", "works_at", "A", 30.0, None, 30.0),
        (3, "s", "works_at", "A", 40.0, 35.0, 40.0),  # same value again, an end before its start
        (4, "s", "works_at", "B", 50.0, None, 50.0),
        (5, "s", "works_at", "C", 50.0, None, 60.0),  # corrected afterwards
        (6, "s", "likes", "tea", 1.0, None, 1.0),
    ]
    assert run(spark, rows) == {("s", "works_at", "A", 10, 20), ("s", "works_at", "A", 30, 50), ("s", "works_at", "C", 50, -1)}


def test_one_hot_key_and_empty(spark):
    rows = [(i, "s", "name_is", f"n{i % 2}", float(i), None, float(i)) for i in range(2000)]
    assert len(run(spark, rows, 50.0)) == 2000
    assert run(spark, []) == set()
