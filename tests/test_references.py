from __future__ import annotations

import pytest

from engramlake.operators.references import Referrer, orphan_counts, orphan_references

T = "id bigint, source_id bigint, created_at double, key string, kind string"
P = "id bigint, created_at double, parent_id bigint"


def cases(spark, refs, parents, gone, **how):
    return orphan_references(
        [Referrer("triples", spark.createDataFrame(refs, T), "id", "source_id", check_late=True), Referrer("memories", spark.createDataFrame(parents, P), "id", "parent_id")],
        spark.createDataFrame(parents, P),
        spark.createDataFrame(gone, "memory_id bigint, deleted_at double"),
        **how,
    )


@pytest.mark.parametrize("hot_rows", [100_000, 2, 1])
def test_kinds_and_periods(spark, hot_rows):
    jan, feb = 1_704_067_200.0, 1_706_745_600.0
    refs = [
        (1, 10, jan, "x", "y"),  # fine
        (2, 11, jan, None, None),  # stored later than the triple
        (3, 12, jan, None, None),  # deleted
        (4, 13, feb, None, None),  # never there
        (4, 13, feb, None, None),  # delivered twice
        (5, None, jan, None, None),
        (6, 0, jan, None, None),
        (7, -1, jan, None, None),
        (8, 14, None, None, None),  # no time
        (None, 14, jan, None, None),
        (9, 15, jan, None, None),  # in the log, but there again
    ]
    parents = [(10, jan, None), (11, feb, 99), (15, jan, 0), (15, jan, 0), (None, jan, 10)]
    got = {tuple(r) for r in cases(spark, refs, parents, [(12, 1.0), (12, None), (15, 2.0), (None, 3.0)], hot_rows=hot_rows).collect()}
    assert got == {
        ("triples", 2, "late", "2024-01"),
        ("triples", 3, "deleted", "2024-01"),
        ("triples", 4, "missing", "2024-02"),
        ("triples", 8, "missing", None),
        ("memories", 11, "missing", "2024-02"),
    }


def test_counts_hot_key_and_empty(spark):
    refs = [(k, 5, 0.0, None, None) for k in range(3000)]
    got = cases(spark, refs, [], [], hot_rows=1000)
    assert [tuple(r) for r in orphan_counts(got).collect()] == [("triples", "missing", "1970-01", 3000)]
    assert cases(spark, [], [], []).collect() == []
