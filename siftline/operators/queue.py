"""The ingestion queue as pure functions: (jobs, input) -> new jobs, each with `now` given.

Jobs have id, document_id, status, attempt, locked_at, locked_by, created_at, and may have updated_at, last_error,
current_stage, stage_updated_at, processing_started_at, processing_duration_ms, chunks_total, chunks_processed; a transition
changes those of them that are there. Ids may repeat in an input; each job changes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a document becomes when its job gets there.
DOCUMENT_STATUS = {"processing": "processing", "completed": "ready", "failed": "queued", "dead_letter": "failed"}


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def millis(later: Column, earlier: Column) -> Column:
    """Whole milliseconds between two moments, none if it's the other way round."""
    return F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 1000))


def spent(jobs: DataFrame, now: Column) -> Column:
    """The duration a job has accumulated when it stops now."""
    has = lambda c: F.col(c) if c in jobs.columns else F.lit(None).cast("timestamp")
    before = F.coalesce("processing_duration_ms", F.lit(0).cast("long")) if "processing_duration_ms" in jobs.columns else F.lit(0).cast("long")
    return before + millis(now, F.coalesce(has("processing_started_at"), has("locked_at"), now))


def changed(jobs: DataFrame, hit: Column, **new: Column) -> DataFrame:
    """jobs with the columns of `new` that it has replaced where hit; its columns and their order stay."""
    put = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items() if c in jobs.columns}
    return jobs.withColumns(put)


def named(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs with _hit: the job is in process and among ids (id, and columns that are carried along); of several rows of one id the
    greatest by these columns counts, whole."""
    rest = [c for c in ids.columns if c != "id"]
    one = ids.groupBy("id").agg(F.max(F.struct(F.lit(True).alias("named"), *rest)).alias("_r")).select("id", *(F.col("_r")[c].alias(f"_{c}") for c in ("named", *rest)))
    return jobs.join(one, "id", "left").withColumn("_hit", F.col("_named").isNotNull() & (F.col("status") == "processing")).select(*jobs.columns, "_hit", *(f"_{c}" for c in rest))


_null = lambda kind: F.lit(None).cast(kind)


def _free(stage: Column, now: Column, duration: Column) -> dict[str, Column]:
    return {"locked_at": _null("timestamp"), "locked_by": _null("string"), "current_stage": stage, "stage_updated_at": now, "processing_duration_ms": duration, "processing_started_at": _null("timestamp"), "updated_at": now}


def claim(jobs: DataFrame, now: str, batch: int = 1, lock_seconds: int = 900, retries: int = 3, worker: str = "worker") -> DataFrame:
    """Stale locks out of retries go to dead letter, then the oldest `batch` of the queued, failed and stale jobs are claimed,
    ties by id. The oldest are a top-k, which each task cuts to `batch` rows before they meet."""
    t, batch, retries = at(now), max(batch, 1), max(retries, 1)
    cutoff = t - F.make_interval(secs=F.lit(max(lock_seconds, 1)))
    stale = (F.col("status") == "processing") & F.col("locked_at").isNotNull() & (F.col("locked_at") <= cutoff)
    dead = F.coalesce(stale & (F.col("attempt") >= retries), F.lit(False))
    can = (F.col("status").isin("queued", "failed") & F.col("locked_at").isNull()) | (stale & (F.col("attempt") < retries))
    chosen = jobs.where(can).orderBy("created_at", "id").limit(batch).select(F.col("id").alias("_id"))
    j = jobs.join(chosen, jobs.id == chosen._id, "left").withColumns({"_mine": F.col("_id").isNotNull(), "_dead": dead, "_spent": spent(jobs, t), "_stale": F.coalesce(stale, F.lit(False))})
    j = changed(j, F.col("_dead"), status=F.lit("dead_letter"), last_error=F.lit(f"Exceeded max retries ({retries}) with stale lock"), **_free(F.lit("dead_letter"), t, F.col("_spent")))
    longer = F.when(F.col("_stale"), F.col("_spent")).otherwise(F.col("processing_duration_ms")) if "processing_duration_ms" in jobs.columns else F.lit(None)
    j = changed(j, F.col("_mine"), status=F.lit("processing"), attempt=F.col("attempt") + 1, locked_at=t, locked_by=F.lit(worker or "worker"), current_stage=F.lit("claimed"), stage_updated_at=t, processing_duration_ms=longer, processing_started_at=t, updated_at=t)
    return j.select(jobs.columns)


def complete(jobs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Jobs in process among ids are completed and lose their lock and error."""
    j = named(jobs, ids.select("id")).withColumn("_spent", spent(jobs, at(now)))
    return changed(j, F.col("_hit"), status=F.lit("completed"), last_error=_null("string"), **_free(F.lit("completed"), at(now), F.col("_spent"))).select(jobs.columns)


def fail(jobs: DataFrame, ids: DataFrame, now: str, retries: int = 3) -> DataFrame:
    """Jobs in process among ids (id, error) fail, for good once their attempts are used up; errors are cut at 4000."""
    j = named(jobs, ids.select("id", "error")).withColumn("_spent", spent(jobs, at(now)))
    end = F.when(F.col("attempt") >= max(retries, 1), "dead_letter").otherwise("failed")
    return changed(j, F.col("_hit"), status=end, last_error=F.left(F.coalesce("_error", F.lit("unknown_error")), F.lit(4000)), **_free(end, at(now), F.col("_spent"))).select(jobs.columns)


def give_back(jobs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Jobs in process among ids are queued anew, at attempt 0 and without a lock."""
    j = named(jobs, ids.select("id")).withColumn("_spent", spent(jobs, at(now)))
    return changed(j, F.col("_hit"), status=F.lit("queued"), attempt=F.lit(0), **_free(F.lit("yielded"), at(now), F.col("_spent"))).select(jobs.columns)


def checkpoint(jobs: DataFrame, progress: DataFrame, now: str) -> DataFrame:
    """Progress of jobs in process (id, chunks_total, chunks_processed, stage; null keeps what was) and a fresh lease."""
    j = named(jobs, progress.select("id", "chunks_total", "chunks_processed", "stage"))
    moved = F.col("_stage").isNotNull() & ~F.col("_stage").eqNullSafe(F.col("current_stage"))
    when = F.when(moved | F.col("stage_updated_at").isNull(), at(now)).otherwise(F.col("stage_updated_at"))
    j = j.withColumn("_when", when)
    return changed(j, F.col("_hit"), chunks_total=F.coalesce("_chunks_total", "chunks_total"), chunks_processed=F.coalesce("_chunks_processed", "chunks_processed"), current_stage=F.coalesce("_stage", "current_stage"), stage_updated_at=F.col("_when"), locked_at=at(now), updated_at=at(now)).select(jobs.columns)


def propagate(documents: DataFrame, before: DataFrame, after: DataFrame, now: str) -> DataFrame:
    """documents (document_id, status, updated_at) as their jobs' changes of status leave them; of several changed jobs of one
    document the newest counts."""
    moved = after.join(before.select("id", F.col("status").alias("_old")), "id").where("status <> _old")
    last = moved.groupBy("document_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("_job"))
    status = F.create_map(*(F.lit(x) for kv in DOCUMENT_STATUS.items() for x in kv))[F.col("_job")]
    j = documents.join(last, "document_id", "left").withColumn("_new", status)
    return changed(j, F.col("_new").isNotNull(), status=F.col("_new"), updated_at=at(now)).select(documents.columns)


def ensure(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs to insert, one for each document (document_id, sha256, ingestion_version) that has none."""
    lacking = documents.join(jobs.select("document_id"), "document_id", "left_anti")
    return lacking.select("document_id", F.lit("queued").alias("status"), F.lit(0).alias("attempt"), F.concat("sha256", F.lit(":v"), F.col("ingestion_version").cast("string")).alias("idempotency_key"))


def document_decisions(effective: DataFrame) -> DataFrame:
    """What reconciliation would change of documents (document_id, status, job_status, chunk_count, effective_status)."""
    reason = F.when((F.col("job_status") == "completed") & (F.col("chunk_count") == 0), "completed_job_without_chunks").otherwise(F.concat(F.lit("latest_job_"), F.coalesce("job_status", F.lit("null"))))
    return effective.where("effective_status <> status").select("document_id", "status", F.col("effective_status").alias("target"), reason.alias("reason"))


def job_decisions(jobs: DataFrame) -> DataFrame:
    """What reconciliation would change of jobs: those in process without a full lock, and others with any."""
    full = F.col("locked_at").isNotNull() & F.col("locked_by").isNotNull()
    any_ = F.col("locked_at").isNotNull() | F.col("locked_by").isNotNull()
    busy = F.col("status") == "processing"
    reason = F.when(busy & ~full, "processing_without_full_lock").when(~busy & any_, "non_processing_job_with_lock")
    return jobs.withColumn("reason", reason).where("reason is not null").select("id", "document_id", "status", F.when(busy, "queued").otherwise(F.col("status")).alias("target"), "reason")


def compare_and_set(rows: DataFrame, decisions: DataFrame, key: str, now: str, clear_lock: bool = False) -> DataFrame:
    """rows whose status is still the one a decision (key, status, target) was made for take its target."""
    d = decisions.groupBy(key).agg(F.min(F.struct("status", "target")).alias("_d"))
    j = rows.join(d, key, "left").withColumn("_hit", F.col("_d").isNotNull() & (F.col("status") == F.col("_d.status")))
    free = {"locked_at": _null("timestamp"), "locked_by": _null("string")} if clear_lock else {}
    return changed(j, F.col("_hit"), status=F.col("_d.target"), updated_at=at(now), **free).select(rows.columns)


def bump_version(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents (document_id, ingestion_version) go to the next version if theirs is still the one asked for."""
    a = asked.groupBy("document_id").agg(F.min("ingestion_version").alias("_v"))
    j = documents.join(a, "document_id", "left")
    return changed(j, F.coalesce(F.col("_v") == F.col("ingestion_version"), F.lit(False)), ingestion_version=F.col("ingestion_version") + 1, status=F.lit("queued")).select(documents.columns)


def duplicate_upload(status: Column, owner: Column, user: Column) -> Column:
    """A struct (reuses, requeues) of an upload whose digest a document has: only an own or nobody's document is reused, and
    it is queued again if it failed."""
    mine = owner.isNull() | (owner == user)
    return F.struct(mine.alias("reuses"), (mine & status.isin("failed", "dead_letter")).alias("requeues"))


def heartbeat(jobs: DataFrame, now: str, stale_minutes: int = 20, lag_minutes: int = 5) -> DataFrame:
    """One row on jobs in process: without a lock, else stale, else lagging, the longest lag in seconds, and a map of stages."""
    t = at(now)
    minutes = lambda n: F.make_interval(mins=F.lit(n))
    locked = F.col("locked_at").isNotNull() & (F.coalesce("locked_by", F.lit("")) != "")
    kind = F.when(~locked, "unlocked").when(F.col("locked_at") <= t - minutes(stale_minutes), "stale").otherwise("live")
    lag = F.greatest(F.lit(0), F.floor((F.unix_micros(t) - F.unix_micros("updated_at")) / 1_000_000))
    rows = jobs.withColumns({"_kind": kind, "_stage": F.coalesce(F.nullif(F.trim("current_stage"), F.lit("")), F.lit("unknown"))})
    counts = rows.agg(F.count_if(F.col("_kind") == "stale").alias("stale"), F.count_if(F.col("_kind") == "unlocked").alias("unlocked"), F.count_if((F.col("_kind") == "live") & (F.col("updated_at") <= t - minutes(lag_minutes))).alias("lagging"), F.max(F.when(F.col("_kind") == "live", lag)).alias("max_lag"))
    return counts.crossJoin(as_map(rows, "_stage", "stages"))  # one row each


def as_map(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row: a map of the few values of key to their counts, by key; empty without rows."""
    g = rows.groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def mismatches(effective: DataFrame) -> DataFrame:
    """One row: documents in process whose latest job isn't, and ready ones without chunks."""
    return effective.agg(F.count_if((F.col("status") == "processing") & ~F.col("job_status").eqNullSafe(F.lit("processing"))).alias("inconsistent"), F.count_if((F.col("status") == "ready") & (F.col("chunk_count") == 0)).alias("ready_without_chunks"))


def runtime_snapshot(jobs: DataFrame, effective: DataFrame, cache: DataFrame, now: str, progress: int = 15, stale: int = 20, lag: int = 5, version: int = 1) -> DataFrame:
    """One row on the whole runtime: queue, jobs in process, documents by effective status, cache. Each part is one pass; the
    parts of one row each are crossed."""
    t, minutes = at(now), lambda n: F.make_interval(mins=F.lit(max(n, 0)))
    s, locked = F.col("status"), F.col("locked_at").isNotNull() & F.col("locked_by").isNotNull()
    busy, live = s == "processing", F.col("locked_at") > t - minutes(stale)
    age = F.greatest(F.lit(0), F.floor((F.unix_micros(t) - F.unix_micros("updated_at")) / 1_000_000))
    queue = jobs.agg(
        F.count_if(s == "queued").alias("queued_count"), F.count_if(busy).alias("processing_count"),
        F.count_if(s.isin("processing", "completed", "failed", "dead_letter") & (F.col("updated_at") >= t - minutes(progress))).alias("recent_progress_count"),
        F.count_if(busy & locked & ~live).alias("stale_processing_count"), F.count_if(busy & locked & live & (F.col("updated_at") <= t - minutes(lag))).alias("lagging_processing_count"),
        F.max(F.when(busy & locked & live, age)).cast("int").alias("max_heartbeat_lag_seconds"), F.count_if(busy & ~locked).alias("processing_without_lock_count"),
        F.count_if(s.isin("queued", "failed", "dead_letter", "completed") & F.col("locked_at").isNotNull()).alias("non_processing_with_lock_count"),
    )
    stage = F.coalesce(F.nullif(F.trim("current_stage"), F.lit("")), F.lit("unknown"))
    stages = as_map(jobs.where(busy).withColumn("_stage", stage), "_stage", "stage_counts")
    e = F.col("effective_status")
    by_status = F.create_map(*(x for k in ("queued", "processing", "ready", "failed") for x in (F.lit(k), F.count_if(e == k))))
    documents = effective.agg(by_status.alias("effective_document_counts")).crossJoin(mismatches(effective).toDF("inconsistent_document_count", "ready_without_chunks_count"))
    v = F.col("retrieval_version")
    cached = cache.agg(F.count("*").alias("total_cache_entries"), F.count_if(v == version).alias("current_version_cache_entries"), F.count_if(v < version).alias("stale_version_cache_entries"), F.count_if(F.col("expires_at") <= t).alias("expired_cache_entries"))
    return queue.crossJoin(stages).crossJoin(documents).crossJoin(cached)


def worker_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many jobs a run claimed, completed, failed and gave up, from the jobs before and after it."""
    moved = after.join(before.select("id", F.col("status").alias("_old"), F.col("attempt").alias("_n")), "id")
    s = F.col("status")
    new = s != F.col("_old")
    return moved.agg(F.count_if(F.col("attempt") > F.col("_n")).alias("claimed"), F.count_if(new & (s == "completed")).alias("completed"), F.count_if(new & (s == "failed")).alias("failed"), F.count_if(new & (s == "dead_letter")).alias("dead_lettered"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
