"""Habits as hypervectors: encoding, bundling, nearest habits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.text import tokens
from engramlake.functions.vectors import DIM, bind, encode, hexed, similarity


def pair_vector(subject: Column, predicate: Column, dim: int = DIM) -> Column:
    """A concept pair, bound."""
    return bind(encode(subject, dim), encode(predicate, dim))


def first_word(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), r"\s+"), 1)


def encoded(habits: DataFrame, text_col: str = "description", dim: int = DIM) -> DataFrame:
    """``habits`` with hv: the pair (first word, whole text), bound."""
    return habits.withColumn("hv", pair_vector(first_word(F.col(text_col)), F.col(text_col), dim))


def _counters(packed: np.ndarray) -> np.ndarray:
    """(rows, words) packed signs to (rows, 64 * words) of +1 and -1."""
    bits = np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=1, bitorder="little")
    return 1 - 2 * bits.astype(np.int32)


def _pack(sums: np.ndarray) -> np.ndarray:
    """Signs of (rows, dim) sums, +1 on a tie, as (rows, dim / 64) packed numbers."""
    return np.packbits(sums < 0, axis=1, bitorder="little").view(np.int64)


def _majority(dim: int):
    def run(words: pd.Series) -> pd.Series:
        none = np.zeros(dim // 64, np.int64)
        rows = (np.frombuffer(bytes.fromhex("".join(w)), ">i8").astype(np.int64).reshape(-1, dim // 64) if w is not None and len(w) else None for w in words)
        return pd.Series([none if r is None else _pack(_counters(r).sum(0, keepdims=True))[0] for r in rows])

    return F.pandas_udf(run, T.ArrayType(T.LongType()))


def bag_encoded(habits: DataFrame, id_col: str, text_col: str = "description", dim: int = DIM) -> DataFrame:
    """(id, hv): the bundle of a text's distinct words, so texts with common words are similar.

    Words are hashed in generated code; one vectorised call bundles a row's.
    """
    words = F.transform(F.array_distinct(tokens(F.col(text_col))), lambda w: hexed(w, dim))
    return habits.select(id_col, _majority(dim)(words).alias("hv"))


#: Groups whose counters a task holds before it passes them on.
HELD_GROUPS = 2_000


def bundle(vectors: DataFrame, by: list[str], dim: int = DIM) -> DataFrame:
    """The bundle of each group's vectors (column hv): the sign of the sums, +1 on a tie.

    Each task adds its vectors up to one row of ``dim`` counters per group, and
    only those rows are shuffled, whatever the size of a group.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*by, "sums"])
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            signs = _counters(np.stack(pdf["hv"].to_numpy()).astype(np.int64))
            groups = pdf.groupby(by, dropna=False, sort=False).indices.items() if by else [((), np.arange(len(pdf)))]
            for key, at in groups:
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held.get(key, 0) + signs[at].sum(0)
                if len(held) >= HELD_GROUPS:
                    yield rows()
        if held:
            yield rows()

    types = dict(vectors.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "sums array<int>"])
    parts = vectors.where(F.col("hv").isNotNull()).select(*by, "hv").mapInPandas(partial, schema)
    sums = parts.select(*by, F.posexplode("sums").alias("at", "s")).groupBy(*by, "at").agg(F.sum("s").alias("s"))
    rows = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("c"))  # dim counters a group
    bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i)
    word = lambda w: F.aggregate(bit, F.lit(0).cast("long"), lambda v, i: v.bitwiseOR(F.when(F.get(F.col("c.s"), w * 64 + i) < 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return rows.select(*by, F.transform(F.sequence(F.lit(0), F.lit(dim // 64 - 1)), word).alias("hv"))


def nearest(habits: DataFrame, query: Column, k: int = 5, least: float | None = None) -> DataFrame:
    """The k habits (with hv) most similar to a query vector; ``least`` is applied after the k."""
    best = habits.withColumn("similarity", F.round(similarity(F.col("hv"), query), 6)).orderBy(F.desc("similarity"), "habit_id").limit(k)
    return best if least is None else best.where(F.col("similarity") > least)


def beside(memories_found: DataFrame, habits: DataFrame, query: str, memories: int = 7, k: int = 3) -> DataFrame:
    """The best memories of a search and the ``k`` habits nearest to the query: id, domain, level, score, in this order.

    A habit's score is its confidence. ``memories_found`` are a hybrid search's
    rows with its order in level, score, src and pos.
    """
    name = F.when(F.col("level") == 2, "principle").when(F.col("level") == 1, "pattern").otherwise("fact")
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce("level", F.lit(0))), F.desc("score"), "src", "pos")  # a search's few rows
    first = memories_found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= memories)
    asked = bag_encoded(habits.sparkSession.range(1).select(F.col("id").alias("habit_id"), F.lit(query).alias("description")), "habit_id")
    near = nearest(bag_encoded(habits, "habit_id").crossJoin(F.broadcast(asked.select(F.col("hv").alias("q")))), F.col("q"), k).select("habit_id", "similarity")
    rows = habits.join(F.broadcast(near), "habit_id").withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "habit_id")))
    both = first.select(F.lit(0).alias("_part"), "_at", "id", "domain", name.alias("level"), "score").unionByName(
        rows.select(F.lit(1).alias("_part"), "_at", F.col("habit_id").alias("id"), F.lit("habits").alias("domain"), F.lit("habit").alias("level"), F.col("confidence").alias("score"))
    )
    return both.orderBy("_part", "_at").limit(memories + k).select("id", "domain", "level", F.round("score", 6).alias("score"))
