"""From messages to memories: the gate, profiles, conversation triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.rules import GATE_PATTERNS, GUARDED_DOMAINS, PROFILE_PATTERNS, captures, detect_domain, first_category
from engramlake.functions.text import strip


def user_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") == "user")


def gate(messages: DataFrame, rules=GATE_PATTERNS) -> DataFrame:
    """Memory rows of the user messages a rule finds: content, domain, level, privacy, ts, category, source.

    ``messages`` has role, content and ts (epoch seconds). Of equal texts the
    earliest counts. Null and blank texts give nothing.
    """
    text = user_messages(messages).where(F.col("content").isNotNull()).select(strip(F.col("content")).alias("content"), "ts")
    hit = text.withColumn("category", first_category(F.col("content"), rules)).where(F.col("category").isNotNull())
    first = hit.groupBy("content").agg(F.min("ts").alias("ts"), F.first("category").alias("category"))
    domain = detect_domain(F.col("content"))
    return first.select(
        "content",
        domain.alias("domain"),
        F.lit(0).alias("level"),
        F.when(domain.isin(*GUARDED_DOMAINS), "guarded").otherwise("open").alias("privacy"),
        "ts",
        "category",
        F.lit("gate").alias("source"),
    )


def gate_counters(messages: DataFrame) -> DataFrame:
    """One row: messages processed (each msg_id once), texts matched (each once), domains detected. One scan, each rule once a row."""
    text = F.when((F.col("role") == "user") & F.col("content").isNotNull(), strip(F.col("content")))
    rows = messages.select("msg_id", text.alias("_t")).withColumn("_hit", first_category(F.col("_t")).isNotNull())
    # what is shuffled has no text but that of hits
    each = rows.select("msg_id", F.when(F.col("_hit"), F.col("_t")).alias("_t")).distinct().groupBy("_t").agg(F.count(F.lit(1)).alias("n"))
    domain = detect_domain(F.col("_t"))
    found = each.withColumn("_d", F.when(F.col("_t").isNotNull(), domain))
    return found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("processed"),
        F.count("_t").alias("matched"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_d") != "", F.col("_d")))), ",").alias("domains"),
    )


def profile_facts(messages: DataFrame, keep: list[str], rules=PROFILE_PATTERNS) -> DataFrame:
    """What user messages say of the user: keep columns, ts, facet, key, value."""
    text = user_messages(messages).where(F.col("content").isNotNull())

    def of_facet(facet: str) -> Column:
        found = captures(F.col("content"), rules[facet])
        return F.transform(found, lambda h: F.struct(F.lit(facet).alias("facet"), h["key"].alias("key"), h["value"].alias("value")))

    hits = text.select(*keep, "ts", F.explode(F.concat(*[of_facet(f) for f in rules])).alias("h"))
    return hits.select(*keep, "ts", "h.facet", "h.key", "h.value")


def profile_latest(facts: DataFrame, by: list[str], facets: tuple[str, ...] = ("who", "what")) -> DataFrame:
    """The last value of each key (ties: the greatest value)."""
    rows = facts.where(F.col("facet").isin(*facets))
    return rows.groupBy(*by, "facet", "key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def profile_how(facts: DataFrame, by: list[str]) -> DataFrame:
    """All preferences of each key in order of time, joined by '; '; a value contained in the text so far is left out."""
    rows = facts.where(F.col("facet") == "how").groupBy(*by, "key", "value").agg(F.min("ts").alias("ts"))
    listed = rows.groupBy(*by, "key").agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("vs"))
    joined = F.aggregate(
        "vs",
        F.lit(""),
        lambda text, v: F.when(text == "", v["value"]).when(F.contains(text, v["value"]), text).otherwise(F.concat(text, F.lit("; "), v["value"])),
    )
    return listed.select(*by, "key", joined.alias("value"))


def every_n(messages: DataFrame, n: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The messages at which a conversation has another n turns."""
    w = Window.partitionBy(conversation).orderBy(turn, "msg_id")
    return messages.withColumn("n_turns", F.row_number().over(w)).where(F.col("n_turns") % n == 0)


def save_points(messages: DataFrame, n: int = 15, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The user messages at which another n user messages of a conversation are there."""
    w = Window.partitionBy(conversation).orderBy(turn, "msg_id")
    human = user_messages(messages).withColumn("n_human", F.row_number().over(w))
    return human.where(F.floor(F.col("n_human") / n) > F.floor((F.col("n_human") - 1) / n))
