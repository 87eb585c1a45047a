"""Sinks: snapshots, vote logs, training lines, contribution and digest files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramlake.functions.rules import contributor_hash


def write_snapshot(store: DataFrame, path: str, version: int) -> str:
    """A new version of the store, sorted inside files so that domain and time prune row groups."""
    out = f"{path}/v={version:08d}"
    # ranges, not hashes: a domain with a third of the rows fills many tasks
    store.repartitionByRange(F.col("domain"), F.col("ts")).sortWithinPartitions("domain", "ts").write.parquet(out)
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that are there, oldest first (from file names, no file is read); none: an empty list."""
    try:
        files = spark.read.parquet(path).inputFiles()
    except AnalysisException:
        return []
    return sorted({int(m.group(1)) for f in files if (m := re.search(r"/v=(\d+)/", f))})


def read_snapshot(spark: SparkSession, path: str, version: int | None = None, schema: StructType | None = None) -> DataFrame:
    """A version of a table (default: the latest); with ``schema``, columns an older version lacks are null."""
    found = versions(spark, path)
    if not found:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/v={found[-1] if version is None else version:08d}")


def save_next(table: DataFrame, path: str) -> int:
    """Write a table of habits, profiles or scores as its next version; returns the version."""
    found = versions(table.sparkSession, path)
    number = found[-1] + 1 if found else 1
    table.write.parquet(f"{path}/v={number:08d}")
    return number


def append_votes(votes: DataFrame, path: str) -> None:
    """Append to the vote log, one folder per month."""
    votes.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("append").partitionBy("month").json(path)


def write_training(examples: DataFrame, path: str) -> None:
    """One JSON object with its messages per line."""
    examples.select("messages").write.json(path)


def contributions(funnel: DataFrame) -> DataFrame:
    """Shared texts as files: name (by content, so a text is written once), text of the file."""
    rows = funnel.where("outcome = 'shared'").select(F.concat(F.lit("c-"), F.substring(contributor_hash(F.col("text")), 1, 12)).alias("name"), "text")
    header = F.concat(F.lit("---\nid: "), F.col("name"), F.lit("\ndomain: general\ntags: "), F.substring("text", 1, 50), F.lit("\n---\n\n"))
    return rows.dropDuplicates(["name"]).select("name", F.concat(header, F.col("text"), F.lit("\n")).alias("file"))


#: Longest digest file, and where a longer one is cut.
DIGEST_CHARS, DIGEST_CUT = 3500, 3450


def digest_file(text: str) -> str:
    return text if len(text) <= DIGEST_CHARS else text[:DIGEST_CUT] + "\n(shortened)\n"
