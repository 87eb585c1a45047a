"""Readers: conversations, transcripts, topic files, documents with front matter, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions.text import strip

MESSAGE_SCHEMA = "role string, content string, timestamp double, metadata map<string,string>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Conversation JSON lines: role and content are required, blank lines are skipped, a broken line fails the read."""
    rows = spark.read.schema(MESSAGE_SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.where(F.col("role").isNotNull() & F.col("content").isNotNull()).withColumnRenamed("timestamp", "ts")


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON lines; broken lines are dropped."""
    return spark.read.schema("type string, role string, content string").option("mode", "DROPMALFORMED").json(path)


def human_messages(rows: DataFrame) -> DataFrame:
    """One row with the number of human messages (type human, or role user)."""
    human = F.coalesce(F.col("role") == "user", F.lit(False))
    if "type" in rows.columns:
        human = human | F.coalesce(F.col("type") == "human", F.lit(False))
    return rows.agg(F.count_if(human).alias("n_human"))


def topic_lines(texts: DataFrame, key: str, text_col: str, title: str | None = None) -> DataFrame:
    """Rows of topic texts: key, line_no, content, source_project, section.

    ``##`` sets the section, other headings and blank lines are skipped, a tag
    ``[source:X]`` at the start is split off, contents of at most five
    characters are dropped. Before a section the title (default: key) counts.
    """
    lines = texts.select(F.col(key), (F.col(title) if title else F.col(key).cast("string")).alias("_title"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "_raw"))
    lines = lines.withColumn("_line", strip(F.col("_raw")))
    mark = F.when(F.col("_line").startswith("##"), strip(F.regexp_replace("_line", "^#+", "")))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("section", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.col("_title")))
    tag = r"(?U)^\[(?:source|来源):?\s*([\w-]+)\]\s*(.*)"
    has_tag = F.col("_line").rlike(tag)
    return (
        filled.where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
        .select(
            key,
            "line_no",
            F.when(has_tag, strip(F.regexp_extract("_line", tag, 2))).otherwise(F.col("_line")).alias("content"),
            F.when(has_tag, F.regexp_extract("_line", tag, 1)).otherwise("").alias("source_project"),
            "section",
        )
        .where(F.length("content") > 5)
    )


def front_matter(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """Documents with a header: key, id, domain, tags, refs, context, symptom, fix, body; others are left out.

    The header lies between two ``---`` lines. In the body, ``context:`` and
    ``symptom:`` give their line's rest (the last one counts); ``fix:`` its
    rest and the bullets after it up to a blank line, joined by '; '.
    """
    whole = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n(.*)"
    text = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    rows = texts.select(key, text.alias("_t")).where(F.col("_t").rlike(whole))
    rows = rows.select(key, F.regexp_extract("_t", whole, 1).alias("_head"), strip(F.regexp_extract("_t", whole, 2)).alias("body"))
    head = F.filter(F.split("_head", "\n"), lambda x: x.contains(":"))
    # the last of equal keys counts
    pairs = F.transform(head, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))

    def field(name: str):
        return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"], F.lit(""))

    lines = F.transform(F.split("body", "\n"), strip)

    def last_line(name: str):
        found = F.filter(lines, lambda x: x.startswith(name + ":"))
        return F.when(F.size(found) > 0, strip(F.substring(F.try_element_at(found, F.lit(-1)), len(name) + 2, 1 << 30))).otherwise("")

    # a fold over the lines: whether inside a fix, and its parts so far
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("parts"))

    def step(s, x):
        rest = strip(F.substring(x, 5, 1 << 30))
        return (
            F.when(x.startswith("context:") | x.startswith("symptom:"), F.struct(F.lit(False).alias("on"), s["parts"].alias("parts")))
            .when(x.startswith("fix:"), F.struct(F.lit(True).alias("on"), F.when(rest != "", F.concat(s["parts"], F.array(rest))).otherwise(s["parts"]).alias("parts")))
            .when(s["on"] & x.startswith("- "), F.struct(F.lit(True).alias("on"), F.concat(s["parts"], F.array(F.substring(x, 3, 1 << 30))).alias("parts")))
            .when(s["on"] & (x == ""), F.struct(F.lit(False).alias("on"), s["parts"].alias("parts")))
            .otherwise(s)
        )

    fix = F.aggregate(lines, start, step)["parts"]
    return rows.select(
        key,
        *[field(n).alias(n) for n in ("id", "domain", "tags", "refs")],
        last_line("context").alias("context"),
        last_line("symptom").alias("symptom"),
        F.array_join(fix, "; ").alias("fix"),
        "body",
    )


def import_documents(texts: DataFrame, key: str, text_col: str, known: DataFrame) -> DataFrame:
    """What importing documents with front matter does: key, outcome (imported, skipped, error), content, domain, name.

    A document's memory is its symptom, fix and context, or the first 200
    characters of its body; its domain the first one of its header. Without a
    header it is an error. Of equal (content, domain) the smallest key counts,
    and what ``known`` (content, domain of active memories) has is skipped.
    """
    heads = front_matter(texts, key, text_col)
    parts = [F.when(F.col(c) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("symptom", "fix", "context")]
    said = F.concat_ws(" | ", *parts)
    first = F.lower(strip(F.element_at(F.split("domain", ","), 1)))
    rows = heads.select(key, F.when(said != "", said).otherwise(F.substring("body", 1, 200)).alias("content"), F.when(F.col("domain") != "", first).otherwise("community").alias("domain"), F.col("id").alias("name"))
    rank = F.row_number().over(Window.partitionBy("content", "domain").orderBy(key))
    there = known.select(F.col("content").alias("_c"), F.col("domain").alias("_d")).distinct().withColumn("_k", F.lit(True))
    marked = rows.withColumn("_r", rank).join(there, (F.col("content") == F.col("_c")) & (F.col("domain") == F.col("_d")), "left")
    done = marked.select(key, F.when((F.col("_r") == 1) & F.col("_k").isNull(), "imported").otherwise("skipped").alias("outcome"), "content", "domain", "name")
    none = F.lit(None).cast("string")
    broken = texts.join(heads.select(key), key, "left_anti").select(key, F.lit("error").alias("outcome"), none.alias("content"), none.alias("domain"), none.alias("name"))
    return done.unionByName(broken)


def import_uses(imported: DataFrame, at: Column) -> DataFrame:
    """One use of each imported entry, for the vote log: entry_id, vote, is_usage, ts."""
    return imported.where("outcome = 'imported' AND name <> ''").select(F.col("name").alias("entry_id"), F.lit(None).cast("int").alias("vote"), F.lit(True).alias("is_usage"), at.alias("ts"))


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Whole text files: file (name), text."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def file_counts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Files and their bytes in a folder, one row: n_files, n_bytes (from the listing, no file is read)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    return rows.agg(F.count_distinct("path").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """A registry file {"projects": {name: {...}}}: one row per project, name and its fields as JSON."""
    rows = spark.read.text(path, wholetext=True)
    found = F.from_json(F.get_json_object("value", "$.projects"), "map<string,string>")
    return rows.select(F.explode(found).alias("name", "about"))
