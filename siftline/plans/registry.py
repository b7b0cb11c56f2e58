"""Where queries and their SQL are registered, and pieces of SQL that several catalogs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import ranking as R
from siftline.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-30 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


JOBS = """jobs AS (SELECT event_id AS id, user_id AS document_id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'failed' ELSE 'dead_letter' END AS status,
  CAST(event_id % 5 AS INTEGER) AS attempt, ts AS created_at, CASE WHEN event_type = 'view' OR (event_type = 'purchase' AND event_id % 11 = 0) THEN ts END AS locked_at,
  CASE WHEN (event_type = 'view' OR (event_type = 'purchase' AND event_id % 11 = 0)) AND event_id % 9 <> 0 THEN 'w' || (user_id % 7) END AS locked_by, ts + to_minutes(event_id % 7) AS updated_at,
  CASE event_id % 5 WHEN 0 THEN 'embedding' WHEN 1 THEN 'storing' WHEN 2 THEN '  ' WHEN 4 THEN 'extracting' END AS current_stage FROM events)"""
POOL = """pool AS (SELECT CASE WHEN doc_id // 50 % 4 = 1 THEN 1000000000 + doc_id // 2 ELSE doc_id // 50 END AS query_id, doc_id AS chunk_id, CAST(CASE WHEN doc_id // 50 % 5 = 0 THEN 0 ELSE doc_id % 7 END AS BIGINT) AS document_id, CAST(n_chars % 11 AS INTEGER) AS page, (n_chars % 101) / 100.0::DOUBLE AS score,
  CASE WHEN doc_id % 3 > 0 THEN (n_chars % 89) / 88.0::DOUBLE END AS similarity, (n_chars % 13) / 12.0::DOUBLE AS lexical, CAST(doc_id % 2 AS INTEGER) AS exact, CAST(coalesce(lang = 'en', false) AS INTEGER) AS same_language,
  CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'cross_encoder' ELSE 'heuristic' END AS scale, text AS content, source AS title, CASE WHEN doc_id % 4 > 0 THEN left(text, 60) END AS context, upper(lang) AS language
  FROM documents),
listed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS ord FROM pool)"""


def pool(spark, d):
    """Documents as candidates: a query for each fifty ids, or for each two of them, some of one document, with scores made from
    their sizes."""
    n, i = F.col("n_chars"), F.col("doc_id")
    q = F.floor(i / 50)
    document = F.when(q % 5 == 0, 0).otherwise(i % 7).cast("long")
    scale = F.when(i % 11 != 0, F.when(i % 2 == 0, "cross_encoder").otherwise("heuristic"))
    texts = [F.col("text").alias("content"), F.col("source").alias("title"), F.when(i % 4 > 0, F.left("text", F.lit(60))).alias("context"), F.upper("lang").alias("language")]
    rows = table(spark, d, "documents").select(F.when(q % 4 == 1, 1_000_000_000 + F.floor(i / 2)).otherwise(q).alias("query_id"), i.alias("chunk_id"), document.alias("document_id"), (n % 11).cast("int").alias("page"), ((n % 101) / 100).alias("score"), F.when(i % 3 > 0, (n % 89) / 88).alias("similarity"), ((n % 13) / 12).alias("lexical"), (i % 2).cast("int").alias("exact"), F.coalesce(F.col("lang") == "en", F.lit(False)).cast("int").alias("same_language"), scale.alias("scale"), *texts)
    return R.ranked(rows, [F.desc("score"), F.col("chunk_id")])
