"""All queries of the llm subpackage and their SQL, by name."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.canonical import look_alike_pairs, with_canonical
from engramlake.llm.knn import neighbour_pairs, neighbours
from engramlake.llm.leaks import find_leaks, leak_report
from engramlake.llm.near import group_pairs, group_sizes, near_groups
from engramlake.llm.pii import kinds_found, scan_pii
from engramlake.llm.sentences import split_sentences
from engramlake.llm.tokenize import encode_corpus
from engramlake.session import table

#: Where the vocabulary files of public tokenizers lie; a parameter, nothing is copied.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours(table(spark, sf_dir, "memories"), "id", "embedding")
    return found.withColumn("similarity", F.round("similarity", 6))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_pairs(neighbours(table(spark, sf_dir, "memories"), "id", "embedding"))


def p8_ids(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"), vocabulary)


def p9_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_tiles(spark, sf_dir).select("doc_id", "item_id")


def p9_mostly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold at least half of an item, in whatever order its passages stand."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), min_coverage=0.5)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items and the documents that hold some of each."""
    return leak_report(p9_tiles(spark, sf_dir)).select("item_id", "n_docs")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(p9_tiles(spark, sf_dir))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people told the assistant: src, row_id, content of both tables, rows delivered twice still twice."""
    memories = table(spark, sf_dir, "memories").select(F.lit("memories").alias("src"), F.col("id").alias("row_id"), "content")
    messages = table(spark, sf_dir, "messages").select(F.lit("messages").alias("src"), F.col("msg_id").alias("row_id"), "content")
    return memories.unionByName(messages)


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_pii(told(spark, sf_dir), "content", ["src", "row_id"])
    return scanned.select("src", "row_id", F.size("found").alias("n_found"), "redacted").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds_found(scan_pii(told(spark, sf_dir), "content", ["src", "row_id"]), ["src", "row_id"])


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "memories"), "id", "domain", "content")


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sizes(p5_groups(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(p5_groups(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(told(spark, sf_dir), "row_id", "content", by=["src"])


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_canonical(told(spark, sf_dir).distinct(), "content").select("src", "row_id", "canonical")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p5_sizes": p5_sizes,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p10_found": p10_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_tiles": p9_tiles,
    "p9_report": p9_report,
    "p9_mostly": p9_mostly,
    "p9_items": p9_items,
}

_WORDS = """
WITH w AS (
  SELECT {id} AS k, regexp_extract_all(regexp_replace(lower(text), '(\\p{{Han}})', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {t}
  WHERE text IS NOT NULL
)
SELECT DISTINCT k, array_to_string(ws[i : i + 11], ' ') AS gram FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 12)"""

_LEAKS = (
    "WITH d AS (" + _WORDS.format(id="doc_id", t="documents") + "), i AS (" + _WORDS.format(id="item_id", t="eval_items") + "),"
    " found AS (SELECT DISTINCT d.k AS doc_id, i.k AS item_id FROM d JOIN i ON d.gram = i.gram)"
)


# Fixed values of the SQL, kept apart from the operator's generated table so that one checks the other: pairs of rows, each character of the first prints like that below it.
_SQL_LETTERS = (
    ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))),  # full width
    ("｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝ", "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"),
    ("АВЕКМНОРСТХЅІЈ", "ABEKMHOPCTXSIJ"),
    ("аеорсухѕіјёЁїЇ", "aeopcyxsijëËïÏ"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp"),
    ("‐‑‒−", "----"),
    ("\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", " " * 16),
)
_SQL_UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\u3164"
_SQL_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
_SQL_JOINING = "\u0600-\u08ff\u0900-\u0dff\u2600-\u27bf\ufe0f\U0001f000-\U0001faff"


def _form_sql(text: str) -> str:
    """The form in SQL: joiners that show are set aside, then characters are translated and composed."""
    for joiner, mark in (("\u200c", "\ue000"), ("\u200d", "\ue001")):
        for _ in range(2):  # neighbours overlap
            text = f"regexp_replace({text}, '([{_SQL_JOINING}]){joiner}([{_SQL_JOINING}])', '\\1{mark}\\2', 'g')"
    stored, shown = ("".join(rows) for rows in zip(*_SQL_LETTERS, strict=True))
    sql = f"translate({text}, '{stored}{_SQL_UNSEEN}', '{shown.replace(chr(39), chr(39) * 2)}')"
    for one, letters in _SQL_LIGATURES.items():
        sql = f"replace({sql}, '{one}', '{letters}')"
    return f"replace(replace(nfc_normalize({sql}), '\ue000', '\u200c'), '\ue001', '\u200d')"


_TOLD = """told AS (
  SELECT DISTINCT 'memories' AS src, id AS row_id, content FROM memories
  UNION ALL SELECT DISTINCT 'messages', msg_id, content FROM messages
)"""
_FORMS = "WITH " + _TOLD + ", form AS (SELECT *, CASE WHEN regexp_matches(content, '[^\\x00-\\x7F]') THEN " + _form_sql("content") + " ELSE content END AS canonical FROM told)"

_NEAR = """WITH RECURSIVE m AS (
  SELECT DISTINCT id, domain, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS t FROM memories WHERE content IS NOT NULL AND domain <> ''
),
g AS (SELECT id, domain, list_distinct(list_transform(generate_series(1, length(t) - 3), lambda i: substr(t, i, 4))) AS s FROM m WHERE length(t) >= 4),
c AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM g a JOIN g b ON a.domain = b.domain AND a.id < b.id),
link AS (SELECT x, y FROM c WHERE i >= 0.6 * (n - i)),
e AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r AS (SELECT x AS a, y AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)"""

_BEST = """WITH v AS (
  SELECT DISTINCT ON (id) id, CAST(embedding AS DOUBLE[]) AS e FROM memories WHERE id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
c AS (SELECT a.id, b.id AS neighbour, round(list_dot_product(a.e, b.e) / (a.n * b.n), 12) AS s FROM u a JOIN u b ON a.id <> b.id),
best AS (SELECT * FROM c WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) <= 5)"""

ORACLE: dict[str, str] = {
    "p7_neighbours": _BEST + " SELECT id, neighbour, round(s, 6) AS similarity FROM best",
    "p7_found": _BEST + " SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM best",
    "p5_found": _NEAR + " SELECT a AS id_a, b AS id_b FROM r WHERE a < b",
    "p5_groups": _NEAR + " SELECT a AS id, min(b) AS group_id FROM r GROUP BY a",
    "p5_sizes": _NEAR + " SELECT group_id, count(*) AS n FROM (SELECT a, min(b) AS group_id FROM r GROUP BY a) GROUP BY 1",
    "p9_found": _LEAKS + " SELECT * FROM found",
    "p9_items": _LEAKS + " SELECT item_id, count(*) AS n_docs FROM found GROUP BY 1",
    "p6_forms": _FORMS + " SELECT src, row_id, canonical FROM form",
    "p6_found": _FORMS
    + " SELECT a.src, least(a.row_id, b.row_id) AS id_a, greatest(a.row_id, b.row_id) AS id_b FROM form a JOIN form b"
    " ON a.src = b.src AND a.canonical = b.canonical AND a.row_id < b.row_id AND a.content <> b.content",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
