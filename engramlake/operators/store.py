"""The memory store: reads, snapshot writes, counters, decay.

Tables are immutable snapshots. A write takes a snapshot and a delta and gives
the next snapshot; nothing is updated in place, so any of them can be redone.
Time never comes from the clock: ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.session import cut


ACTIVE, ARCHIVED = "active", "archived"
FACT, PATTERN, PRINCIPLE = 0, 1, 2
DAY = 86_400.0

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("privacy", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("hit_count", T.IntegerType()),
        T.StructField("last_hit_at", T.DoubleType()),
        T.StructField("decay_count", T.IntegerType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def once(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows delivered twice count once. They are equal in every column, so by all columns of ``df``, unless a key is given.

    Filters on a result by all columns are pushed below it to the scan; by a
    key they would not be.
    """
    return df.dropDuplicates([key] if key else None)


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == ACTIVE)


def newest(df: DataFrame, n: int, by: list[str], *order: Column) -> DataFrame:
    """The first n rows of each group in an order; only n rows per group and task reach the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def _key(df: DataFrame) -> list[Column]:
    return [F.coalesce("content", F.lit("")), F.coalesce("domain", F.lit(""))]


def add_new(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` (content, domain, ts, ...) no active memory has, each once, with new ids.

    The id of a row is the highest id of the store plus its rank; of equal
    (content, domain) in ``fresh`` the earliest counts.
    """
    known = active(store).select(*[c.alias(n) for c, n in zip(_key(store), ("_c", "_d"), strict=True)]).distinct()
    w = Window.partitionBy(*_key(fresh)).orderBy("ts", "content")
    first = fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    new = first.join(known, (F.coalesce(first["content"], F.lit("")) == known["_c"]) & (F.coalesce(first["domain"], F.lit("")) == known["_d"]), "left_anti")
    return _numbered(new, store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))


def _numbered(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Consecutive ids in the order (ts, content, domain), without pulling all rows through one task.

    Rows are ranked inside ranges; the ranges' sizes, one row each, are summed up.
    """
    ordered = rows.repartitionByRange(F.col("ts"), F.col("content"), F.col("domain")).sortWithinPartitions("ts", "content", "domain")
    # written once: the ranges must be the same ones for the ranks and for the sums
    placed = cut(ordered.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    inside = placed.withColumn("_p", part).withColumn("_i", F.col("_m") - F.shiftleft(part, 33) + 1)
    sizes = inside.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    joined = inside.join(before.select("_p", F.coalesce("_before", F.lit(0)).alias("_before")), "_p").crossJoin(F.broadcast(top))
    return joined.withColumn("id", F.col("_top") + F.col("_before") + F.col("_i")).drop("_m", "_p", "_i", "_before", "_top")


def exists(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The (content, domain) rows of ``wanted`` that an active memory has."""
    known = active(store).select("content", "domain").distinct()
    return wanted.join(known, ["content", "domain"], "left_semi")


def updated(store: DataFrame, delta: DataFrame, set_nulls: bool = False) -> DataFrame:
    """The next snapshot: columns of ``delta`` (id and any others) replace those of the same id.

    A null in ``delta`` leaves the value as it is, or, with ``set_nulls``, clears it.
    """
    change = [c for c in delta.columns if c != "id"]
    new = delta.select("id", F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in change])
    joined = store.join(new, "id", "left")
    value = {c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) if set_nulls else F.coalesce(f"_{c}", c) for c in change}
    return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in store.columns])


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The next snapshot without the ids."""
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def children(store: DataFrame, parents: DataFrame) -> DataFrame:
    """Active children of the parents (id), with parent_id."""
    return active(store).join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def metadata_map(store: DataFrame) -> DataFrame:
    """``metadata`` as map<string,string>; broken or empty JSON gives an empty map."""
    parsed = F.from_json("metadata", "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return store.withColumn("metadata", F.coalesce(parsed, empty))


def counts(store: DataFrame) -> DataFrame:
    """One row: totals of active and archived memories and of each level."""
    on = F.col("status") == ACTIVE
    return store.agg(
        F.count_if(on).alias("total_active"),
        F.count_if(on & (F.col("level") == FACT)).alias("facts"),
        F.count_if(on & (F.col("level") == PATTERN)).alias("patterns"),
        F.count_if(on & (F.col("level") == PRINCIPLE)).alias("principles"),
        F.count_if(F.col("status") == ARCHIVED).alias("archived"),
    )


def domain_counts(store: DataFrame) -> DataFrame:
    """Memories ever stored per domain (all statuses; no domain is no group)."""
    return store.where(F.col("domain") != "").groupBy("domain").agg(F.count(F.lit(1)).alias("memory_count"))


def level_rollup(store: DataFrame) -> DataFrame:
    """Active memories by (domain, level), by domain, and in total, in one pass."""
    return (
        active(store)
        .rollup("domain", "level")
        .agg(F.grouping_id().cast("int").alias("depth"), F.count(F.lit(1)).alias("n"))
    )


def hit_rollup(store: DataFrame, hits: DataFrame) -> DataFrame:
    """The next snapshot after a log of hits (id, ts): counts added, latest time kept."""
    sums = hits.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.max("ts").alias("_t"))
    joined = store.join(sums, "id", "left")
    new = {
        "hit_count": F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_hit_at": F.greatest("last_hit_at", "_t"),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in store.columns])


def decays(now: float, days: float = 30) -> Column:
    """Whether a memory decays: last hit before the cutoff, or never hit and stored before it."""
    cutoff = now - days * DAY
    return ((F.col("last_hit_at") > 0) & (F.col("last_hit_at") < cutoff)) | ((F.col("hit_count") == 0) & (F.col("created_at") < cutoff))


def decay_candidates(store: DataFrame, now: float, days: float = 30, per_domain: int | None = None) -> DataFrame:
    """Active facts that decay: id, decay_count. ``per_domain``: only so many newest facts of each domain are looked at."""
    facts = active(store).where((F.col("level") == FACT) & (F.col("domain") != ""))
    if per_domain is not None:
        facts = newest(facts, per_domain, ["domain"], F.col("ts").desc(), F.col("id"))
    return facts.where(decays(now, days)).select("id", "decay_count")


def decayed(store: DataFrame, now: float, days: float = 30, strikes: int = 3, per_domain: int | None = None) -> DataFrame:
    """The next snapshot after a decay pass: counts raised, memories with ``strikes`` archived."""
    marked = decay_candidates(store, now, days, per_domain).select("id", F.lit(1).alias("_hit"))
    joined = store.join(marked, "id", "left")
    count = F.coalesce("decay_count", F.lit(0)) + F.coalesce("_hit", F.lit(0))
    status = F.when(F.col("_hit").isNotNull() & (count >= strikes), ARCHIVED).otherwise(F.col("status"))
    new = {"decay_count": count.cast("int"), "status": status}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in store.columns])
