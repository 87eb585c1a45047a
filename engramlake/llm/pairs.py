"""Joins whose result is all pairs of a key, cut into blocks so that a hot key fills many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a key that one task pairs at a time.
BLOCK_ROWS = 4_096


def meet_in_blocks(a: DataFrame, b: DataFrame, keys: Sequence[str], id_a: str, id_b: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a`` joined with ``b`` on ``keys`` (no nulls), for results that list all pairs of a key.

    The rows of a key are split into blocks by hash of their id and every block
    of the one side meets every block of the other, so no task gets more than
    two blocks of a key. Rows are repeated once per block of the other side,
    which is far less than the pairs they make.
    """

    def sized(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        return counts.where(F.col("_n") > block_rows).select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias(name))

    # keys with more than a block: at most rows / block_rows of them
    hot = sized(a, "_pa").join(sized(b, "_pb"), list(keys), "full_outer").select(*keys, F.coalesce("_pa", F.lit(1)).alias("_pa"), F.coalesce("_pb", F.lit(1)).alias("_pb"))

    def blocked(df: DataFrame, own: str, other: str, id_col: str, mine: str, theirs: str) -> DataFrame:
        rows = df.join(hot, list(keys), "left")
        block = F.pmod(F.xxhash64(id_col, F.lit(3)), F.coalesce(own, F.lit(1))).cast("int")
        return rows.withColumn(mine, block).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_pa", "_pb")

    left, right = blocked(a, "_pa", "_pb", id_a, "_i", "_j"), blocked(b, "_pb", "_pa", id_b, "_j", "_i")
    return left.join(right, [*keys, "_i", "_j"]).drop("_i", "_j")
