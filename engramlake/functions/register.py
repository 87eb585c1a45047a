"""The engine's functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from engramlake.operators.refine import actions_of, insights_of


@udtf(returnType="description: string, confidence: double")
class ParseInsights:
    """parse_insights(answer): one row per insight of a model's answer."""

    def eval(self, answer: str) -> Iterator[tuple[str, float]]:
        yield from insights_of(answer)


@udtf(returnType="type: string, id: bigint, detail: string")
class ParseActions:
    """parse_actions(answer): one row per action of a model's answer."""

    def eval(self, answer: str) -> Iterator[tuple[str, int | None, str]]:
        yield from actions_of(answer)


#: SQL functions that stay in generated code: name, parameters, result, body.
_SCALARS = (
    ("hv_similarity", "a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "1 - 2 * aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n) / (64.0D * size(a))"),
    ("word_overlap", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN least(size(a), size(b)) > 0 THEN size(array_intersect(a, b)) / CAST(least(size(a), size(b)) AS DOUBLE) ELSE 0.0D END"),
    ("score_at", "raw DOUBLE, age_days DOUBLE", "DOUBLE", "raw * exp(-ln(2.0D) / 125.0D * age_days)"),
)


def register(spark: SparkSession) -> None:
    """Make parse_insights and parse_actions callable in SQL, also with LATERAL, and the scalar functions of ``_SCALARS``."""
    spark.udtf.register("parse_insights", ParseInsights)
    spark.udtf.register("parse_actions", ParseActions)
    for name, takes, gives, body in _SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
