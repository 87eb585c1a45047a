"""Consolidation carried out: redundant facts merged, decay and redundancy in one pass, summaries above what they sum up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.operators.refine import redundant_pairs
from engramlake.operators.store import ACTIVE, ARCHIVED, decayed

#: A merger or summariser: the texts, in order, to one text; an empty answer changes nothing.
Summary = Callable[[list[str]], str]

#: Overlap of words above which the second of two facts is redundant.
REDUNDANT = 0.6
#: Parents that mean none.
NO_PARENT = (0, -1)


def _summed_up(groups: DataFrame, key: str, kind: str, summarise: Summary) -> DataFrame:
    """(key, text) of groups (key, texts array<string>) of bounded size; empty answers are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({key: pdf[key], "text": [summarise([t for t in ts if t is not None]) for ts in pdf["texts"]]})
            yield out[out["text"].fillna("").str.strip() != ""]

    return groups.select(key, "texts").mapInPandas(run, f"`{key}` {kind}, text string")


def without_redundancy(store: DataFrame, merge: Summary | None = None, above: float = REDUNDANT) -> DataFrame:
    """The next snapshot after redundant pairs are merged: the second is archived, the first keeps the higher hit count.

    Pairs are those of ``redundant_pairs``, at most 30 for each of the largest
    domains. ``merge`` gives the first one's new text (None: it keeps its own);
    a pair whose merger is empty stays as it is. Repeated rows are all changed.
    """
    pairs = redundant_pairs(store).where(F.col("overlap") > above).select("id_a", "id_b")
    facts = store.select("id", "content", "hit_count").dropDuplicates(["id"])
    b = facts.select(F.col("id").alias("id_b"), F.col("content").alias("_cb"), F.col("hit_count").alias("_hb"))
    listed = pairs.join(b, "id_b").groupBy("id_a").agg(F.max("_hb").alias("_hb"), F.sort_array(F.collect_list(F.struct("id_b", "_cb"))).alias("_b"))
    if merge is not None:
        first = listed.join(facts.select(F.col("id").alias("id_a"), F.col("content").alias("_ca")), "id_a")
        new = _summed_up(first.select("id_a", F.concat(F.array("_ca"), F.col("_b._cb")).alias("texts")), "id_a", "bigint", merge)
        listed = listed.join(new, "id_a")
    else:
        listed = listed.withColumn("text", F.lit(None).cast("string"))
    gone = listed.select(F.explode("_b.id_b").alias("id")).distinct().withColumn("_gone", F.lit(True))
    kept = listed.select(F.col("id_a").alias("id"), "_hb", "text")
    joined = store.join(kept, "id", "left").join(gone, "id", "left")
    changed = {
        "content": F.coalesce("text", "content"),
        "hit_count": F.greatest("hit_count", "_hb"),
        "status": F.when(F.col("_gone"), ARCHIVED).otherwise(F.col("status")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in store.columns])


def pruned(store: DataFrame, now: float, merge: Summary | None = None) -> DataFrame:
    """The next snapshot after the two prunings of a dream: decay first, then redundancy among what is still active."""
    return without_redundancy(decayed(store, now), merge)


def no_parent(parent: Column) -> Column:
    return parent.isNull() | parent.isin(*NO_PARENT)


def aggregated(store: DataFrame, due: DataFrame, level: int, now: float, summarise: Summary | None = None) -> DataFrame:
    """What summaries change: new rows one ``level`` up, and the rows below them that had no parent, with their new parent.

    ``due`` has domain, id and rn, as the candidates of a level (a bounded
    number for each domain). One summary for each domain; its id follows the
    highest id, by domain. Without ``summarise`` the texts are joined by '; '.
    Columns are those of the store.
    """
    rows = store.dropDuplicates(["id"])
    facts = rows.join(due.select("id", "rn"), "id")
    listed = facts.groupBy("domain").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "content"))), lambda x: x["content"]).alias("texts"))
    if summarise is None:
        texts = listed.select("domain", F.array_join("texts", "; ").alias("text")).where(F.trim("text") != "")
    else:
        texts = _summed_up(listed, "domain", "string", summarise)
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # one row for each domain that is due
    new = texts.crossJoin(F.broadcast(top)).withColumn("_id", F.col("_top") + F.row_number().over(Window.orderBy("domain")))
    fresh = {
        "id": F.col("_id"), "content": F.col("text"), "domain": F.col("domain"), "ts": F.lit(now), "level": F.lit(level), "status": F.lit(ACTIVE), "privacy": F.lit("open"),
        "hit_count": F.lit(0), "last_hit_at": F.lit(0.0), "decay_count": F.lit(0), "created_at": F.lit(now), "metadata": F.lit('{"source": "aggregation"}'),
    }
    types = dict(store.dtypes)
    above = new.select(*[fresh.get(c, F.lit(None)).cast(types[c]).alias(c) for c in store.columns])
    below = facts.where(no_parent(F.col("parent_id"))).join(new.select("domain", "_id"), "domain")
    return above.unionByName(below.select(*[F.col("_id").cast(types[c]).alias(c) if c == "parent_id" else F.col(c) for c in store.columns]))


def with_changes(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: rows of ``changes`` in place of those of the same id, and its new ones."""
    return store.join(changes.select("id").distinct(), "id", "left_anti").select(*store.columns).unionByName(changes.select(*store.columns))

