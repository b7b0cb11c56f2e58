"""SQL functions of the engine, for those who write SQL: temporary, for one session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import SEARCH_CONFIG

FUNCTIONS = {
    "language_text_search_config(language STRING)": ("STRING", "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEARCH_CONFIG.items()) + " ELSE 'english' END"),
    "build_keyword_query(q STRING)": ("ARRAY<STRING>", r"array_distinct(filter(split(lower(q), '[^\\p{L}\\p{N}]+'), t -> length(t) >= 3))"),
    "app_role(claims STRING)": ("STRING", "coalesce(get_json_object(claims, '$.app_metadata.role'), 'anonymous')"),
    "is_admin(claims STRING)": ("BOOLEAN", "get_json_object(claims, '$.app_metadata.role') <=> 'admin'"),
    "is_reader_or_admin(claims STRING)": ("BOOLEAN", "coalesce(get_json_object(claims, '$.app_metadata.role') IN ('reader', 'admin'), false)"),
    "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": (
        "DOUBLE",
        "CASE WHEN size(a) <> size(b) OR aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 1D ELSE 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates all of them and returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]


def missing(spark: SparkSession, required: list[str]) -> list[str]:
    """Functions that are required but not there."""
    return [x for x in required if not spark.catalog.functionExists(x)]
