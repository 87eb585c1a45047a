"""Structured Streaming: the batch functions per micro-batch, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramlake.operators.gate import gate, profile_facts, user_messages
from engramlake.operators.triples import from_text
from engramlake.session import cut, drop


def stream_ingest(messages: DataFrame, out: str, checkpoint: str, rules=None, fold: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Take in a stream of messages: memories, each content once, profile facts and triples, in folders of ``out``.

    Of what is stored, a micro-batch reads only the keys of contents, 16 bytes
    each. It writes to folders named by its id and overwrites them, so a batch
    run twice leaves one copy. ``fold`` is called with the new memories and the
    batch's id, e.g. to see which domains are due for a summary.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = cut(rows)  # read several times
        new = (gate(rows, rules) if rules else gate(rows)).withColumn("key", F.unhex(F.md5("content")))
        old = stored(spark, f"{out}/memories")
        if old is not None:
            new = new.join(old.where(F.col("batch") < number).select("key"), "key", "left_anti")
        target = f"{out}/memories/batch={number}"
        new.write.mode("overwrite").parquet(target)
        profile_facts(rows, []).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        said = user_messages(rows).where(F.col("content").isNotNull())
        from_text(said, "content", ["ts"]).write.mode("overwrite").parquet(f"{out}/triples/batch={number}")
        if fold is not None:
            fold(spark.read.parquet(target), number)
        drop(rows)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_votes(votes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of votes to the log, a folder for each month."""
    rows = votes.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return rows.writeStream.format("json").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, out: str) -> DataFrame | None:
    """What a stream has written so far, or None."""
    try:
        return spark.read.parquet(out)
    except AnalysisException:
        return None


def tumbling(events: DataFrame, width: str = "1 day", at: str = "ts", late: str | None = None) -> DataFrame:
    """Events and mean value per window and type; ``late`` sets a watermark for streams."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("w_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", at: str = "ts", late: str | None = None) -> DataFrame:
    """Sessions of each user: runs of events with less than ``gap`` between them."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(F.session_window(at, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "n")
