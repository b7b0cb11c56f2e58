"""Queue, cache and limiter state as pure functions: (state, input) -> new state or returned rows. `now` is always given."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUS = {"signup": "queued", "view": "processing", "purchase": "completed", "click": "failed", "error": "dead_letter"}


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each document, by (created_at, id)."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def effective(status: Column, chunks: Column, stored: Column) -> Column:
    done = F.coalesce(chunks, F.lit(0)) > 0
    return F.when(status == "processing", "processing").when(status.isin("queued", "failed"), "queued").when(status == "dead_letter", "failed").when((status == "completed") & done, "ready").when(status == "completed", "failed").otherwise(stored)


def effective_statuses(documents: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their latest job, chunk count and effective status."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    last = latest_job(jobs).select("document_id", F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    out = documents.join(last, "document_id", "left").join(counts, "document_id", "left")
    return out.select("document_id", "status", "job_id", "job_status", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), effective(F.col("job_status"), F.col("chunk_count"), F.col("status")).alias("effective_status"))


def upsert(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace the state's rows with their key; others stay. Of rows with one key the smallest counts."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(*(F.col(c) if c == key else F.col("_r")[c].alias(c) for c in rows.columns)) if rest else rows.distinct()
    return state.join(one.select(key), key, "left_anti").unionByName(one)


def cache_read(cache: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """(cache_key, chunks): what the cache (cache_key, retrieval_version, expires_at, chunks) holds of asked (cache_key,
    retrieval_version, top_k), as far as it hasn't expired; the first top_k chunks. An empty entry is a miss."""
    live = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp")).where(F.size("chunks") > 0)
    return live.join(asked, ["cache_key", "retrieval_version"]).select("cache_key", F.slice("chunks", 1, F.greatest(F.lit(1), F.col("top_k"))).alias("chunks"))


def cache_touch(cache: DataFrame, hits: DataFrame, now: str) -> DataFrame:
    """cache with hit_count one higher and last_accessed_at set for the keys and versions that hits name."""
    h = hits.select("cache_key", "retrieval_version").distinct().withColumn("_hit", F.lit(True))
    j = cache.join(h, ["cache_key", "retrieval_version"], "left")
    put = {"hit_count": F.col("hit_count") + F.coalesce("_hit", F.lit(False)).cast("int")}
    if "last_accessed_at" in cache.columns:
        put["last_accessed_at"] = F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col("last_accessed_at"))
    return j.withColumns(put).select(cache.columns)


def cache_invalidate(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty cache, and how many entries went."""
    return cache.limit(0), cache.agg(F.count("*").alias("n"))


def history(rows: DataFrame, user: str, limit: int, conversation: int | str | None = None) -> DataFrame:
    """A user's newest rows of a history (id, user_id, conversation_id, created_at), of one conversation if it is named; ties by id."""
    own = rows.where(F.col("user_id") == user)
    own = own if conversation is None else own.where(F.col("conversation_id") == conversation)
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def delete_own(history: DataFrame, ids: DataFrame, user: str) -> tuple[DataFrame, DataFrame]:
    """What stays of a history (id, user_id) when a user deletes ids, and the ids that went: only the user's own."""
    gone = history.where(F.col("user_id") == user).join(ids.select("id").distinct(), "id", "left_semi").select("id")
    return history.join(gone, "id", "left_anti"), gone


def prune(cache: DataFrame, now: str, version: int) -> tuple[DataFrame, DataFrame]:
    """What stays of a cache (expires_at, retrieval_version), and counts of expired and of outdated rows (expired first)."""
    old = F.col("expires_at") <= F.lit(now).cast("timestamp")
    outdated = ~old & (F.col("retrieval_version") < version)
    return cache.where(~old & ~outdated), cache.agg(F.count_if(old).alias("expired"), F.count_if(outdated).alias("outdated"))


def rate_limit(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """Fixed windows that begin with the first hit after the last one ended: hits (bucket, ts, hit_id) with allowed,
    remaining, retry_after in seconds and request_count. Where a window begins depends on all hits before it, so each bucket
    is one pass of one task over its sorted hits, with a state of two numbers, never gathered. Hits without a bucket leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, start, n = None, None, 0
        for b in batches:
            counts, begins = [], []
            times = b["ts"].astype("datetime64[ns]").astype("int64")
            for x, t in zip(b["bucket"], times, strict=True):
                if x != bucket or start + seconds * 1_000_000_000 <= t:
                    bucket, start, n = x, t, 0
                n += 1
                counts.append(n)
                begins.append(start)
            b["request_count"] = counts
            left = np.array(begins, np.int64) + seconds * 1_000_000_000 - times.to_numpy()
            b["retry_after"] = np.maximum(-(-left // 1_000_000_000), 1)
            b["allowed"] = b["request_count"] <= most
            b["remaining"] = (most - b["request_count"]).clip(lower=0)
            yield b[["hit_id", "bucket", "request_count", "allowed", "remaining", "retry_after"]]

    rows = hits.where("bucket is not null").select("hit_id", "bucket", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withColumn("ts", F.expr("cast(ts as timestamp_ntz)"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ts", "hit_id").mapInPandas(run, "hit_id long, bucket long, request_count long, allowed boolean, remaining long, retry_after long")


def visible_chunks(chunks: DataFrame, documents: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Chunks (document_id) of the documents that a user may read."""
    return chunks.join(accessible(documents, user, admin).select("document_id"), "document_id", "left_semi")


def claimed_role(claims: Column) -> Column:
    """The role in a token's claims (JSON): app_metadata.role."""
    return F.get_json_object(claims, "$.app_metadata.role")


def accessible(documents: DataFrame, user: str, admin: bool = False) -> DataFrame:
    """Rows a user may read: ready ones, their own or nobody's; an admin reads all."""
    return documents if admin else documents.where((F.col("status") == "ready") & (F.col("owner").isNull() | (F.col("owner") == user)))
