"""Scores of entries from an append-only log of votes and uses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days in which a score halves, weight of a negative vote.
HALF_LIFE_DAYS, NEGATIVE_WEIGHT = 125.0, 2.0
DAY = 86_400.0


def totals(votes: DataFrame) -> DataFrame:
    """Per entry: positive, negative, usage_count, first_seen, last_vote (epoch seconds, 0: never voted).

    ``votes`` has entry_id, vote (+1, -1, null), is_usage, ts; entries without
    an id are left out. Counts are combined on the map side, so an entry with
    a third of the log is one partial row per task.
    """
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    voted = F.col("vote").isNotNull() & (F.col("vote") != 0)
    return votes.where(F.col("entry_id").isNotNull()).groupBy("entry_id").agg(
        F.count_if(F.col("vote") > 0).alias("positive"),
        F.count_if(F.col("vote") < 0).alias("negative"),
        F.count_if(F.coalesce("is_usage", F.lit(False))).alias("usage_count"),
        F.coalesce(F.min(epoch), F.lit(0.0)).alias("first_seen"),
        F.coalesce(F.max(F.when(voted, epoch)), F.lit(0.0)).alias("last_vote"),
    )


def scores(votes: DataFrame, now: float) -> DataFrame:
    """``totals`` with raw_score, age_days and final_score, which decays with the entry's age."""
    rows = totals(votes)
    raw = F.col("positive") - NEGATIVE_WEIGHT * F.col("negative")
    age = F.when(F.col("first_seen") > 0, (now - F.col("first_seen")) / DAY).otherwise(0.0)
    return (
        rows.withColumn("raw_score", raw)
        .withColumn("age_days", age)
        .withColumn("final_score", F.col("raw_score") * F.exp(-math.log(2) / HALF_LIFE_DAYS * F.col("age_days")))
    )


def top(votes: DataFrame, now: float, n: int = 20) -> DataFrame:
    """The n entries with the highest score."""
    return scores(votes, now).orderBy(F.desc(F.round("final_score", 6)), "entry_id").limit(n)


def proven(uses: int = 5, score: float = 8.0) -> Column:
    """Whether a scored entry is used and liked enough."""
    return (F.col("usage_count") >= uses) & (F.col("final_score") >= score)


def stale(days: float = 180.0, uses: int = 10) -> Column:
    """Whether a scored entry is old and never voted for, or used without a positive score."""
    return ((F.col("age_days") > days) & (F.col("last_vote") == 0)) | ((F.col("usage_count") >= uses) & (F.col("final_score") <= 0))
