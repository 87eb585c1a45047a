from __future__ import annotations

import random
import re

import pytest

from engramlake.llm import leaks as L


def words(t):
    return re.findall(r"[一-鿿]|[^\W_一-鿿]+", t.lower())


def brute(docs, items, n):
    out = set()
    for i, a in items:
        w = words(a or "")
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, b in docs:
            v = words(b or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [40, 10_000])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    vocabulary = ["Ab", "cd", "é", "x1", "ÉF", "中", "文", "q_r", "it's"]
    make = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.randrange(2, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "short")]
    docs = [(k, make(rng.randrange(0, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "..."), (None, make(50))]
    docs += [(100 + k, (make(8) + " " + str(t).upper() + " " + make(5)).replace(" ", "  ")) for k, t in items]
    docs += docs[:3]
    d = spark.createDataFrame([(a, b, "e") for a, b in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id bigint, text string, doc_id int")
    got = [(r.doc_id, r.item_id) for r in L.find_leaks(d, i, 5, block_chars=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([x for x in docs if x[0] is not None], items, 5)


def test_tiles_are_greedy_and_do_not_overlap():
    # one long match, and a shorter one that overlaps it on the item's side
    pairs = [(10 + k, 0 + k) for k in range(6)] + [(30 + k, 4 + k) for k in range(3)]
    got = L.tiles(pairs, 3)
    assert got[0] == (10, 0, 8)
    assert all(t[2] >= 3 for t in got)
    there = [k for _, i, n in got for k in range(i, i + n)]
    assert len(there) == len(set(there))


def test_reordered_passages_count_by_coverage(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    d = spark.createDataFrame([(1, f"{b} and then {a}"), (2, a)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, f"{a} {b}")], "item_id bigint, text string")
    got = {r.doc_id: (r.longest, r.covered, r.item_words) for r in L.find_leaks(d, i, 4, min_coverage=0.9).collect()}
    assert got == {1: (6, 12, 12)}
    assert [tuple(r) for r in L.leak_report(L.find_leaks(d, i, 4)).collect()] == [(7, 2, 1.0)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert L.find_leaks(d, i).collect() == []
    assert L.find_leaks(spark.createDataFrame([(1, "a " * 50)], "doc_id bigint, text string"), i).collect() == []


def test_many_items_of_one_text(spark):
    text = " ".join(f"w{k}" for k in range(14))
    d = spark.createDataFrame([(1, f"so {text} it goes"), (2, "none")], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, text) for k in range(3000)] + [(0, "other " + text)], "item_id bigint, text string")
    got = L.find_leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, k) for k in range(3000)} and len(got) == 3000
