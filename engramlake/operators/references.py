"""References to records that do not exist (problem 3).

The distinct non-null foreign keys of all referring tables are anti-joined
with the parent keys, so a key that a third of the rows share crosses the
shuffle once. The unresolved keys are then joined back to their rows: those of
many rows where the rows are, by a broadcast whose size is bounded by rows
over ``HOT_ROWS``, the others by a shuffle in which no key fills a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.session import cut

#: Rows of one key from which on they are not brought together: at most rows / HOT_ROWS keys have so many.
HOT_ROWS = 100_000
#: Keys that mean "no reference".
NO_KEY = (0, -1)


@dataclass(frozen=True)
class Referrer:
    """A referring table: its name in the report, its row key, its foreign key, and the time it was stored."""

    name: str
    df: DataFrame
    row_id: str
    key: str
    stored_at: str = "created_at"
    #: whether a parent stored after the row counts as a case
    check_late: bool = False


def utc_month(epoch: Column) -> Column:
    """``YYYY-MM`` in UTC of epoch seconds, whatever the session's time zone; null for null or NaN."""
    days = F.when(~F.isnan(epoch), F.floor(epoch / 86400)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def orphan_references(referrers: Sequence[Referrer], parents: DataFrame, deletions: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per unresolved reference: ref_table, row_id, kind, period.

    ``parents`` has id and created_at, ``deletions`` memory_id. Kinds:
    ``deleted`` (no parent, but in the deletion log), ``missing`` (in neither),
    ``late`` (the parent was stored after the referring row). Keys null, 0 and
    -1 are no references; rows delivered twice count once; rows without a row
    id are ignored; a null time gives a null period and is never late. Empty
    tables give no rows (no parents: all references are unresolved).
    """
    refs = None
    for r in referrers:
        one = r.df.select(
            F.lit(r.name).alias("ref_table"),
            F.col(r.row_id).cast("long").alias("row_id"),
            F.col(r.key).cast("long").alias("key"),
            F.col(r.stored_at).cast("double").alias("stored_at"),
            F.lit(r.check_late).alias("check_late"),
        ).where(F.col("key").isNotNull() & ~F.col("key").isin(*NO_KEY) & F.col("row_id").isNotNull())
        one = one.dropDuplicates(["row_id"])
        refs = one if refs is None else refs.unionByName(one)
    if refs is None:
        raise ValueError("no referring table")
    known = (
        parents.select(F.col("id").cast("long").alias("known"), F.col("created_at").cast("double").alias("since"))
        .where(F.col("known").isNotNull())
        .groupBy("known")
        .agg(F.min("since").alias("since"))
    )
    gone = deletions.select(F.col("memory_id").cast("long").alias("gone")).where("gone IS NOT NULL").distinct()
    # one row per distinct key: its parent's time, or that it has none; the latest referrer decides if any can be late
    keys = refs.groupBy("key").agg(F.min(F.when(F.col("check_late"), F.col("stored_at"))).alias("earliest"), F.count(F.lit(1)).alias("rows"))
    unresolved = (
        keys.join(known, F.col("key") == F.col("known"), "left_anti")
        .join(gone, F.col("key") == F.col("gone"), "left")
        .select("key", F.when(F.col("gone").isNotNull(), "deleted").otherwise("missing").alias("kind"), "rows")
    )
    late = (
        keys.join(known, F.col("key") == F.col("known"))
        .where(F.col("since") > F.col("earliest"))
        .select("key", F.lit("late").alias("kind"), "rows", "since")
    )
    cases = cut(unresolved.withColumn("since", F.lit(None).cast("double")).unionByName(late))
    hot, cold = cases.where(F.col("rows") >= hot_rows).drop("rows"), cases.where(F.col("rows") < hot_rows).drop("rows")
    if hot.isEmpty():
        found = refs.join(cold, "key")
    else:
        marked = refs.join(F.broadcast(hot), "key", "left")
        found = marked.where(F.col("kind").isNotNull()).unionByName(marked.where(F.col("kind").isNull()).drop("kind", "since").join(cold, "key"))
    return (
        found.where((F.col("kind") != "late") | (F.col("check_late") & (F.col("stored_at") < F.col("since"))))
        .select("ref_table", "row_id", "kind", utc_month(F.col("stored_at")).alias("period"))
    )


def orphan_counts(cases: DataFrame) -> DataFrame:
    """Cases per table, kind and period; partial counts are combined before the shuffle."""
    return cases.groupBy("ref_table", "kind", "period").agg(F.count(F.lit(1)).alias("n"))
