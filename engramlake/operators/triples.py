"""Temporal triples: closing of validity, as-of reads, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators.history import SINGLE_VALUED, successor


def closed(triples: DataFrame, close_at: str = "created_at") -> DataFrame:
    """Every triple with its end: a newer triple of a single-valued relation closes the open one before it.

    The end is the successor's created_at (or its valid_from with
    ``close_at='valid_from'``); triples of other relations stay as they are. An
    own valid_until counts where there is one.
    """
    single = successor(
        triples.where(F.col("relation").isin(*SINGLE_VALUED)), ["subject", "relation"], "created_at", "_next", tie="id", value=close_at
    )
    other = triples.where(~F.coalesce(F.col("relation").isin(*SINGLE_VALUED), F.lit(False))).withColumn("_next", F.lit(None).cast("double"))
    rows = single.unionByName(other)
    return rows.withColumn("valid_until", F.coalesce("valid_until", "_next")).drop("_next")


def holds_at(t: Column | float) -> Column:
    """Whether a triple is valid at a time."""
    at = t if isinstance(t, Column) else F.lit(float(t))
    return (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))


def as_of(triples: DataFrame, t: float) -> DataFrame:
    return triples.where(holds_at(t))


def current(triples: DataFrame, subject: str | None = None, relation: str | None = None) -> DataFrame:
    """Triples that are still open, optionally of a subject and relation."""
    out = triples.where(F.col("valid_until").isNull())
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    return out if relation is None else out.where(F.col("relation") == relation)


def timeline(triples: DataFrame, subject: str) -> DataFrame:
    """All triples of a subject, expired ones too, by start."""
    return triples.where(F.col("subject") == subject).orderBy(F.col("valid_from").asc_nulls_first(), "id")


#: Seconds of a slice of the as-of join.
ASOF_SLICE = 30 * 86_400.0


def asof_join(events: DataFrame, triples: DataFrame, key: str = "subject", at: str = "at", slice_s: float = ASOF_SLICE) -> DataFrame:
    """Each event with the triples of its key that hold at its time.

    Intervals are posted to the time slices they touch, events to theirs, so
    the join is an equi-join on (key, slice) and one hot key spreads over its
    slices; the range is only checked inside a slice.
    """
    bounds = events.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    spans = triples.crossJoin(F.broadcast(bounds)).where((F.col("valid_from") <= F.col("_hi")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("_lo"))))
    first = F.floor(F.greatest("valid_from", "_lo") / slice_s)
    last = F.floor(F.least(F.coalesce("valid_until", "_hi"), F.col("_hi")) / slice_s)
    spans = spans.withColumn("_slice", F.explode(F.sequence(first, last))).drop("_lo", "_hi")
    points = events.withColumn("_slice", F.floor(F.col(at) / slice_s))
    return points.join(spans, [key, "_slice"]).where(holds_at(F.col(at))).drop("_slice")


def from_text(messages: DataFrame, text_col: str, keep: list[str], rules=None) -> DataFrame:
    """Triples a speaker states about themself: keep columns, subject, relation, object."""
    from engramlake.functions.rules import TRIPLE_PATTERNS, captures

    hits = messages.select(*keep, F.explode(captures(F.col(text_col), rules or TRIPLE_PATTERNS)).alias("h"))
    return hits.select(*keep, F.lit("user").alias("subject"), F.col("h.key").alias("relation"), F.col("h.value").alias("object"))
