"""History of changing attributes (problem 4).

Each key (subject, relation) has a state at every moment: the observation that
started last, until the next one starts or its own end comes before that. The
state that starts at a moment and the state that stops there are consecutive
snapshots of the key; a null-safe full outer join on (key, moment) compares
them: only the new one is there (inserted), only the old one (deleted), both
with different values (changed), or the same value goes on (no event). The
validity of an event ends at the key's next event, by lead.

The join's key contains the moment, so a key with a third of all rows spreads
over all tasks. The successor of a moment is found in two steps (inside a time
slice, then between slices of the same key) for the same reason. Keys are made
non-null once, so the joins are plain ones and keep the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import cut

#: Relations that hold one value at a time (fixed values).
SINGLE_VALUED = ("name_is", "works_at", "located_in", "currently_doing")
#: Seconds of a time slice; a slice of one key is the most one task sorts at once.
SLICE_S = 30 * 86_400.0


def successor(
    df: DataFrame, keys: list[str], at: str, out: str, slice_s: float = SLICE_S, tie: str | None = None, value: str | None = None
) -> DataFrame:
    """Add ``out``: ``value`` (default ``at``) of the next row of ``keys`` in the order of ``at``; null for the last.

    Rows of one key with equal ``at`` need a ``tie`` column that orders them.
    No task gets more of one key than a time slice, plus one row per slice.
    """
    value = value or at
    order = [at] + ([tie] if tie else [])
    # two columns per key: its value without null, and whether it is null
    plain = [c for k in keys for c in (f"_v_{k}", f"_n_{k}")]
    filled = {f"_v_{k}": F.coalesce(k, F.lit("").cast(dict(df.dtypes)[k])) for k in keys} | {f"_n_{k}": F.col(k).isNull() for k in keys}
    sliced = df.withColumns(filled | {"_slice": F.coalesce(F.floor(F.col(at) / slice_s), F.lit(-(1 << 62)))})
    inside = Window.partitionBy(*plain, "_slice").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sliced.withColumns({"_more": F.lead(at).over(inside).isNotNull(), "_next": F.lead(value).over(inside), "_head": F.first(value).over(so_far)})
    within = rows.where("_more").select(*df.columns, F.col("_next").alias(out))
    # the last row of each slice, which knows its slice's first, looks at the key's next slice
    between = Window.partitionBy(*plain).orderBy("_slice")
    last = rows.where("NOT _more").withColumn("_after", F.lead("_head").over(between)).select(*df.columns, F.col("_after").alias(out))
    return within.unionByName(last)


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c).cast("double"))


def observations(triples: DataFrame) -> DataFrame:
    """The observation that counts at each start: subject, relation, start, object, own_end."""
    created = _number("created_at")
    return (
        triples.select("subject", "relation", "object", "id", created.alias("created"), F.coalesce(_number("valid_from"), created).alias("start"), _number("valid_until").alias("own_end"))
        .where(F.col("start").isNotNull())
        .groupBy("subject", "relation", "start")
        .agg(F.max_by(F.struct("object", "own_end"), F.struct("created", "id")).alias("o"))
        .select("subject", "relation", "start", "o.object", "o.own_end")
    )


def states(obs: DataFrame, slice_s: float = SLICE_S) -> DataFrame:
    """What held when: subject, relation, object, start, stop (null: to this day)."""
    led = successor(obs, ["subject", "relation"], "start", "next_start", slice_s)
    own = (F.col("own_end") > F.col("start")) & (F.col("next_start").isNull() | (F.col("own_end") < F.col("next_start")))
    return led.select("subject", "relation", "object", "start", F.when(own, F.col("own_end")).otherwise(F.col("next_start")).alias("stop"))


def change_events(held: DataFrame) -> DataFrame:
    """Events of the states: subject, relation, at, object, change (inserted, changed, deleted)."""
    new = held.select("subject", "relation", F.col("start").alias("at"), F.struct("object").alias("_new"))
    old = held.where(F.col("stop").isNotNull()).select(
        F.col("subject").alias("_s"), F.col("relation").alias("_r"), F.col("stop").alias("_at"), F.struct("object").alias("_old")
    )
    same_key = new["subject"].eqNullSafe(old["_s"]) & (new["relation"] == old["_r"]) & (new["at"] == old["_at"])
    pairs = new.join(old, same_key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(F.col("_new").isNull(), "deleted")
        .when(~F.col("_new.object").eqNullSafe(F.col("_old.object")), "changed")
    )
    gone = F.col("_new").isNull()
    return pairs.select(
        F.when(gone, F.col("_s")).otherwise(F.col("subject")).alias("subject"), F.coalesce("relation", "_r").alias("relation"),
        F.coalesce("at", "_at").alias("at"), F.col("_new.object").alias("object"), change.alias("change"),
    ).where(F.col("change").isNotNull())


def attribute_history(triples: DataFrame, relations: tuple[str, ...] = SINGLE_VALUED, slice_s: float = SLICE_S) -> DataFrame:
    """One row per period: subject, relation, object, from_s, until_s (-1: still open), change.

    ``triples`` has subject, relation, object, id, valid_from, valid_until and
    created_at. A null or NaN valid_from means created_at; an observation with
    neither is left out. Null subjects form one key, a null object is a value
    like any other, repeated rows count once, an empty table gives no rows.
    """
    wanted = triples.where(F.col("relation").isin(*relations))
    events = change_events(cut(states(observations(wanted), slice_s)))
    return (
        successor(events, ["subject", "relation"], "at", "until", slice_s)
        .where(F.col("change") != "deleted")
        .select(
            "subject",
            "relation",
            "object",
            F.floor("at").cast("long").alias("from_s"),
            F.coalesce(F.floor("until").cast("long"), F.lit(-1).cast("long")).alias("until_s"),
            "change",
        )
        .dropDuplicates(["subject", "relation", "object", "from_s", "until_s"])
    )
