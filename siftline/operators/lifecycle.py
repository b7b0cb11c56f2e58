"""Transitions of documents and jobs beyond the queue: functions of (state, input) that return the new state or its change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import queue as Q


def create_documents(existing: DataFrame, incoming: DataFrame, version: int = 1) -> DataFrame:
    """The rows of incoming (doc_id, sha256) to insert, with their job's idempotency key: the first by doc_id of each digest that
    existing (sha256) doesn't hold. A null digest inserts nothing."""
    new = incoming.where("sha256 is not null").join(existing.select("sha256"), "sha256", "left_anti")
    return new.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.concat("sha256", F.lit(f":v{version}")).alias("idempotency_key"))


def requeue_failed(documents: DataFrame) -> DataFrame:
    """Failed documents (document_id, status, ingestion_version) are queued under the next version."""
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    return documents.withColumns({"status": F.when(failed, "queued").otherwise(F.col("status")), "ingestion_version": F.col("ingestion_version") + failed.cast("int")})


def queued_jobs(documents: DataFrame, now: str) -> DataFrame:
    """A queued job row for each of documents (document_id, sha256, ingestion_version)."""
    t = F.lit(now).cast("timestamp")
    key = F.concat("sha256", F.lit(":v"), F.col("ingestion_version").cast("string"))
    return documents.select("document_id", F.lit("queued").alias("status"), F.lit(0).alias("attempt"), key.alias("idempotency_key"), t.alias("created_at"), t.alias("updated_at"))


def create_with_jobs(existing: DataFrame, incoming: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The document rows to insert of incoming (doc_id, sha256), queued under version 1, and a job row for each; see create_documents."""
    new = create_documents(existing, incoming).select(F.col("doc_id").alias("document_id"), F.substring_index("idempotency_key", ":", 1).alias("sha256"), F.lit("queued").alias("status"), F.lit(1).alias("ingestion_version"), F.lit(now).cast("timestamp").alias("created_at"))
    return new, queued_jobs(new, now)


def requeue_with_jobs(documents: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """documents (document_id, sha256, status, ingestion_version), the failed ones queued under the next version, and their job rows."""
    after = requeue_failed(documents.withColumn("_failed", F.coalesce(F.col("status") == "failed", F.lit(False))))
    return after.drop("_failed"), queued_jobs(after.where("_failed"), now)


def bump_with_jobs(documents: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """documents (document_id, sha256, status, ingestion_version), those whose version is still the one asked for under the next one,
    and their job rows. Nobody's change since then is lost: another version than the one asked for stays."""
    after = Q.bump_version(documents.withColumn("_old", F.col("ingestion_version")), asked)
    return after.drop("_old"), queued_jobs(after.where("ingestion_version > _old"), now)


def cascade(documents: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What stays of documents and of each dependent table when the documents among gone (document_id) are deleted."""
    doomed = gone.select("document_id").distinct()
    return documents.join(doomed, "document_id", "left_anti"), {k: v.join(doomed, "document_id", "left_anti") for k, v in dependents.items()}


def stamped(rows: DataFrame, now: str) -> DataFrame:
    """rows as a write stores them: updated_at is now, and tokens are those of title, content and context."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "content", "context")))
    return rows.withColumns({"updated_at": F.lit(now).cast("timestamp"), "tokens": X.tokens(text)})


def missing(required: DataFrame, available: DataFrame, key: str = "name") -> DataFrame:
    """Names that are required but not available."""
    return required.select(key).distinct().join(available.select(key), key, "left_anti")


def cascade_counts(documents: DataFrame, dependents: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """One row: how many documents among gone (document_id) a deletion removes, and how many rows of each dependent table."""
    doomed = documents.join(gone.select("document_id").distinct(), "document_id", "left_semi").select("document_id").distinct()
    out = doomed.agg(F.count("*").alias("documents"))
    for name, rows in dependents.items():
        out = out.crossJoin(rows.join(doomed, "document_id", "left_semi").agg(F.count("*").alias(name)))  # one row each
    return out


def validate(rows: DataFrame, key: str, parent: DataFrame, least: dict[str, float]) -> DataFrame:
    """(check, n): repeated keys, keys without a parent row, and values below their least."""
    twice = rows.groupBy(key).count().where("count > 1").agg(F.lit("unique").alias("check"), F.count("*").alias("n"))
    orphan = rows.join(parent.select(key).distinct(), key, "left_anti").agg(F.lit("parent").alias("check"), F.count("*").alias("n"))
    low = rows.agg(*(F.count_if(F.col(c) < v).alias(c) for c, v in least.items()))
    low = low.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in least))))
    return twice.unionByName(orphan).unionByName(low)
