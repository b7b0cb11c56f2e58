"""Queries on the state of documents, jobs, cache, history and limiter."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import tables as FT
from siftline.operators import lifecycle as L
from siftline.operators import queue as Q
from siftline.operators import state as S
from siftline.plans.registry import JOBS, NOW, SQL, query  # noqa: F401
from siftline.sources.tables import jobs, table

MID = "2024-01-15 12:00:00"
_T, _M = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{MID}'"
DOCS = "docs AS (SELECT c_custkey AS document_id, CASE WHEN c_acctbal > 5000 THEN 'processing' WHEN c_acctbal > 0 THEN 'ready' ELSE 'queued' END AS status, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS owner FROM customer)"
EFFECTIVE = f"""{JOBS}, {DOCS}, l AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM jobs), k AS (SELECT o_custkey AS document_id, count(*) AS chunk_count FROM orders GROUP BY 1),
eff AS (SELECT docs.document_id, docs.status, l.id AS job_id, l.status AS job_status, coalesce(chunk_count, 0) AS chunk_count,
CASE WHEN l.status = 'processing' THEN 'processing' WHEN l.status IN ('queued', 'failed') THEN 'queued' WHEN l.status = 'dead_letter' THEN 'failed' WHEN l.status = 'completed' AND coalesce(chunk_count, 0) > 0 THEN 'ready' WHEN l.status = 'completed' THEN 'failed' ELSE docs.status END AS effective_status
FROM docs LEFT JOIN l ON l.document_id = docs.document_id AND l.r = 1 LEFT JOIN k ON k.document_id = docs.document_id)"""


def documents(spark, d):
    balance = F.col("c_acctbal")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(balance > 5000, "processing").when(balance > 0, "ready").otherwise("queued").alias("status"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("owner"))


def effective(spark, d):
    return S.effective_statuses(documents(spark, d), jobs(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("document_id")))


def asked(spark, d):
    """Every order's number as a job's id, twice."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("error"))
    return o.unionByName(o)


@query(f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM jobs) SELECT document_id, id, status, attempt FROM r WHERE r = 1")
def latest_job(spark, d):
    return S.latest_job(jobs(spark, d)).select("document_id", "id", "status", "attempt")


@query(f"WITH {EFFECTIVE} SELECT * FROM eff")
def effective_status(spark, d):
    return effective(spark, d)


@query(f"WITH {DOCS} SELECT document_id, status, owner FROM docs WHERE status = 'ready' AND (owner IS NULL OR owner = 'BUILDING')")
def rls_documents(spark, d):
    return S.accessible(documents(spark, d), "BUILDING")


@query(f"WITH {DOCS} SELECT o_orderkey AS chunk_id FROM orders WHERE o_custkey IN (SELECT document_id FROM docs WHERE status = 'ready' AND (owner IS NULL OR owner = 'BUILDING'))")
def rls_chunks(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    return S.visible_chunks(chunks, documents(spark, d), "BUILDING").select("chunk_id")


@query(f"WITH {DOCS} SELECT DISTINCT o_custkey AS document_id FROM orders WHERE o_custkey NOT IN (SELECT document_id FROM docs WHERE status = 'ready' AND (owner IS NULL OR owner = 'BUILDING'))")
def unauthorized(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id")).distinct()
    return ids.join(S.accessible(documents(spark, d), "BUILDING"), "document_id", "left_anti")


@query("""SELECT event_id, json_extract_string('{"app_metadata": {"role": "' || event_type || '"}}', '$.app_metadata.role') AS role FROM events""")
def claimed_role(spark, d):
    claims = F.concat(F.lit('{"app_metadata": {"role": "'), "event_type", F.lit('"}}'))
    return table(spark, d, "events").select("event_id", S.claimed_role(claims).alias("role"))


@query(f"""WITH {JOBS}, s AS (SELECT *, coalesce(status = 'processing' AND locked_at <= {_T} - INTERVAL 900 SECOND, false) AS stale FROM jobs),
c AS (SELECT id FROM s WHERE (stale AND attempt < 3) OR (status IN ('queued', 'failed') AND locked_at IS NULL) ORDER BY created_at, id LIMIT 50)
SELECT id, document_id, CASE WHEN stale AND attempt >= 3 THEN 'dead_letter' WHEN id IN (SELECT id FROM c) THEN 'processing' ELSE status END AS status,
CAST(attempt + CASE WHEN id IN (SELECT id FROM c) THEN 1 ELSE 0 END AS INTEGER) AS attempt, CASE WHEN id IN (SELECT id FROM c) THEN 'me' WHEN stale AND attempt >= 3 THEN NULL ELSE locked_by END AS locked_by,
CASE WHEN id IN (SELECT id FROM c) THEN 'claimed' WHEN stale AND attempt >= 3 THEN 'dead_letter' ELSE current_stage END AS current_stage FROM s""")
def claim_jobs(spark, d):
    return Q.claim(jobs(spark, d), NOW, batch=50, worker="me").select("id", "document_id", "status", "attempt", "locked_by", "current_stage")


TIMED = "coalesce(id %% 1000, 0) + CAST(greatest(0, floor((epoch_us(%s) - epoch_us(coalesce(locked_at, %s))) / 1000)) AS BIGINT)"


def timed(spark, d):
    """Jobs with an error and a duration from before."""
    return jobs(spark, d).withColumns({"last_error": F.lit(None).cast("string"), "processing_duration_ms": F.col("id") % 1000})


@query(f"""WITH {JOBS} SELECT j.id, j.document_id, CASE WHEN o.o_orderkey IS NOT NULL AND status = 'processing' THEN CASE WHEN attempt >= 3 THEN 'dead_letter' ELSE 'failed' END ELSE status END AS status, attempt,
CASE WHEN o.o_orderkey IS NOT NULL AND status = 'processing' THEN left(o.o_orderpriority, 4000) END AS last_error, CASE WHEN NOT (o.o_orderkey IS NOT NULL AND status = 'processing') THEN locked_by END AS locked_by,
CASE WHEN o.o_orderkey IS NOT NULL AND status = 'processing' THEN {TIMED % (_T, _T)} ELSE id % 1000 END AS processing_duration_ms FROM jobs j LEFT JOIN orders o ON o.o_orderkey = j.id""")
def fail_jobs(spark, d):
    return Q.fail(timed(spark, d), asked(spark, d), NOW).select("id", "document_id", "status", "attempt", "last_error", "locked_by", "processing_duration_ms")


_HIT = "o.o_orderkey IS NOT NULL AND status = 'processing'"


@query(f"WITH {JOBS} SELECT id, CASE WHEN {_HIT} THEN 'completed' ELSE status END AS status, CASE WHEN NOT ({_HIT}) THEN locked_by END AS locked_by, CASE WHEN {_HIT} THEN {TIMED % (_T, _T)} ELSE id % 1000 END AS processing_duration_ms FROM jobs LEFT JOIN orders o ON o_orderkey = id")
def complete_jobs(spark, d):
    return Q.complete(timed(spark, d), asked(spark, d), NOW).select("id", "status", "locked_by", "processing_duration_ms")


@query(f"WITH {JOBS} SELECT id, CASE WHEN {_HIT} THEN 'queued' ELSE status END AS status, CASE WHEN {_HIT} THEN 0 ELSE attempt END AS attempt FROM jobs LEFT JOIN orders o ON o_orderkey = id")
def yield_jobs(spark, d):
    return Q.give_back(jobs(spark, d), asked(spark, d), NOW).select("id", "status", "attempt")


@query(f"""WITH {JOBS} SELECT id, CASE WHEN {_HIT} AND id % 2 = 0 THEN 20 ELSE 10 END AS chunks_total, CASE WHEN {_HIT} THEN 5 ELSE 1 END AS chunks_processed, CASE WHEN {_HIT} AND id % 3 > 0 THEN 'embedding' ELSE current_stage END AS current_stage,
CASE WHEN {_HIT} AND id % 3 > 0 AND current_stage IS DISTINCT FROM 'embedding' THEN {_T} ELSE updated_at END AS stage_updated_at, CASE WHEN {_HIT} THEN {_T} ELSE locked_at END AS locked_at FROM jobs LEFT JOIN orders o ON o_orderkey = id""")
def checkpoint_jobs(spark, d):
    rows = jobs(spark, d).withColumns({"chunks_total": F.lit(10), "chunks_processed": F.lit(1), "stage_updated_at": F.col("updated_at")})
    i = F.col("id")
    progress = asked(spark, d).select("id", F.when(i % 2 == 0, 20).alias("chunks_total"), F.lit(5).alias("chunks_processed"), F.when(i % 3 > 0, "embedding").alias("stage"))
    done = Q.checkpoint(rows, progress, NOW).select("id", "chunks_total", "chunks_processed", "current_stage", "stage_updated_at", "locked_at")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("stage_updated_at", "locked_at")})


@query(f"""WITH {JOBS}, {DOCS}, m AS (SELECT document_id, arg_max(CASE WHEN attempt >= 3 THEN 'failed' ELSE 'queued' END, (created_at, id)) AS new FROM jobs JOIN orders ON o_orderkey = id WHERE status = 'processing' GROUP BY 1)
SELECT document_id, coalesce(new, status) AS status FROM docs LEFT JOIN m USING (document_id)""")
def propagate_jobs(spark, d):
    before = jobs(spark, d)
    return Q.propagate(documents(spark, d), before, Q.fail(before, asked(spark, d), NOW), NOW).select("document_id", "status")


@query(f"WITH {JOBS} SELECT c_custkey AS document_id, 'queued' AS status, 0 AS attempt, c_name || ':v' || 2 AS idempotency_key FROM customer WHERE c_custkey NOT IN (SELECT document_id FROM jobs)")
def ensure_jobs(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("sha256"), F.lit(2).alias("ingestion_version"))
    return Q.ensure(docs, jobs(spark, d))


@query(f"""WITH {EFFECTIVE} SELECT document_id, status, effective_status AS target, CASE WHEN job_status = 'completed' AND chunk_count = 0 THEN 'completed_job_without_chunks' ELSE 'latest_job_' || coalesce(job_status, 'null') END AS reason FROM eff WHERE effective_status <> status""")
def reconcile_documents(spark, d):
    return Q.document_decisions(effective(spark, d))


RECONCILED = """r AS (SELECT id, document_id, status, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS target,
CASE WHEN status = 'processing' AND (locked_at IS NULL OR locked_by IS NULL) THEN 'processing_without_full_lock' WHEN status <> 'processing' AND (locked_at IS NOT NULL OR locked_by IS NOT NULL) THEN 'non_processing_job_with_lock' END AS reason FROM jobs)"""


@query(f"WITH {JOBS}, {RECONCILED} SELECT * FROM r WHERE reason IS NOT NULL")
def reconcile_jobs(spark, d):
    return Q.job_decisions(jobs(spark, d))


@query(f"WITH {JOBS}, {RECONCILED} SELECT j.id, CASE WHEN r.id IS NOT NULL THEN r.target ELSE j.status END AS status, CASE WHEN r.id IS NULL THEN j.locked_by END AS locked_by FROM jobs j LEFT JOIN (SELECT * FROM r WHERE reason IS NOT NULL AND id % 2 = 0) r ON r.id = j.id")
def reconcile_apply(spark, d):
    """Decisions on odd ids are for a status that has changed since, and so do nothing."""
    rows = jobs(spark, d)
    decided = Q.job_decisions(rows).withColumn("status", F.when(F.col("id") % 2 == 0, F.col("status")).otherwise("completed_since"))
    return Q.compare_and_set(rows, decided, "id", NOW, clear_lock=True).select("id", "status", "locked_by")


@query("SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 = 2 THEN 3 ELSE 2 END AS ingestion_version FROM customer")
def version_bump(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(2).alias("ingestion_version"), F.lit("ready").alias("status"))
    wanted = docs.where("document_id % 2 = 0").select("document_id", F.when(F.col("document_id") % 4 == 2, 2).otherwise(1).alias("ingestion_version"))
    return Q.bump_version(docs, wanted).select("document_id", "ingestion_version")


@query("SELECT c_custkey, c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING' AS reuses, (c_custkey % 3 = 0 OR c_mktsegment = 'BUILDING') AND c_acctbal < 0 AS requeues FROM customer")
def duplicate_uploads(spark, d):
    c = table(spark, d, "customer").withColumns({"status": F.when(F.col("c_acctbal") < 0, "failed").otherwise("ready"), "owner": F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))})
    return c.select("c_custkey", Q.duplicate_upload(F.col("status"), F.col("owner"), F.lit("BUILDING")).alias("u")).select("c_custkey", "u.*")


@query(f"""WITH {JOBS}, p AS (SELECT *, CASE WHEN locked_at IS NULL OR coalesce(locked_by, '') = '' THEN 'unlocked' WHEN locked_at <= {_M} - INTERVAL 20 MINUTE THEN 'stale' ELSE 'live' END AS kind, coalesce(nullif(trim(current_stage), ''), 'unknown') AS stage FROM jobs WHERE status = 'processing')
SELECT count(*) FILTER (kind = 'stale') AS stale, count(*) FILTER (kind = 'unlocked') AS unlocked, count(*) FILTER (kind = 'live' AND updated_at <= {_M} - INTERVAL 5 MINUTE) AS lagging, CAST(max(greatest(0, floor((epoch_us({_M}) - epoch_us(updated_at)) / 1000000))) FILTER (kind = 'live') AS BIGINT) AS max_lag,
(SELECT string_agg(stage || '=' || n, ',' ORDER BY stage) FROM (SELECT stage, count(*) AS n FROM p GROUP BY 1)) AS stages FROM p""")
def heartbeat(spark, d):
    return written(Q.heartbeat(jobs(spark, d).where("status = 'processing'"), MID), "stages")


def written(df, *maps):
    """Maps as text, by key."""
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return df.withColumns({m: text(m) for m in maps})


@query(f"""WITH {EFFECTIVE}, p AS (SELECT *, locked_at IS NOT NULL AND locked_by IS NOT NULL AS locked, locked_at > {_M} - INTERVAL 20 MINUTE AS live FROM jobs), c AS (SELECT ts + INTERVAL 1 DAY AS expires_at, user_id % 3 AS v FROM events)
SELECT (SELECT count(*) FROM jobs WHERE status = 'queued') AS queued_count, (SELECT count(*) FROM jobs WHERE status = 'processing') AS processing_count,
(SELECT count(*) FROM jobs WHERE status <> 'queued' AND updated_at >= {_M} - INTERVAL 15 MINUTE) AS recent_progress_count,
(SELECT count(*) FROM p WHERE status = 'processing' AND locked AND NOT live) AS stale_processing_count, (SELECT count(*) FROM p WHERE status = 'processing' AND locked AND live AND updated_at <= {_M} - INTERVAL 5 MINUTE) AS lagging_processing_count,
(SELECT CAST(max(greatest(0, floor((epoch_us({_M}) - epoch_us(updated_at)) / 1000000))) AS INTEGER) FROM p WHERE status = 'processing' AND locked AND live) AS max_heartbeat_lag_seconds,
(SELECT count(*) FROM p WHERE status = 'processing' AND NOT locked) AS processing_without_lock_count, (SELECT count(*) FROM jobs WHERE status <> 'processing' AND locked_at IS NOT NULL) AS non_processing_with_lock_count,
(SELECT count(*) FROM eff WHERE status = 'processing' AND job_status IS DISTINCT FROM 'processing') AS inconsistent_document_count, (SELECT count(*) FROM eff WHERE status = 'ready' AND chunk_count = 0) AS ready_without_chunks_count,
(SELECT string_agg(s || '=' || n, ',' ORDER BY s) FROM (SELECT coalesce(nullif(trim(current_stage), ''), 'unknown') AS s, count(*) AS n FROM jobs WHERE status = 'processing' GROUP BY 1)) AS stage_counts,
(SELECT 'failed=' || count(*) FILTER (effective_status = 'failed') || ',processing=' || count(*) FILTER (effective_status = 'processing') || ',queued=' || count(*) FILTER (effective_status = 'queued') || ',ready=' || count(*) FILTER (effective_status = 'ready') FROM eff) AS effective_document_counts,
(SELECT count(*) FROM c) AS total_cache_entries, (SELECT count(*) FROM c WHERE v = 1) AS current_version_cache_entries, (SELECT count(*) FROM c WHERE v < 1) AS stale_version_cache_entries, (SELECT count(*) FROM c WHERE expires_at <= {_M}) AS expired_cache_entries""")
def runtime_snapshot(spark, d):
    return written(Q.runtime_snapshot(jobs(spark, d), effective(spark, d), cache(spark, d), MID), "stage_counts", "effective_document_counts")


@query(f"WITH {EFFECTIVE} SELECT count(*) FILTER (status = 'processing' AND job_status IS DISTINCT FROM 'processing') AS inconsistent, count(*) FILTER (status = 'ready' AND chunk_count = 0) AS ready_without_chunks FROM eff")
def document_mismatches(spark, d):
    return Q.mismatches(effective(spark, d))


@query(f"WITH {EFFECTIVE}, keys AS (SELECT unnest(['queued', 'processing', 'ready', 'failed']) AS status) SELECT keys.status, count(e.document_id) AS n FROM keys LEFT JOIN eff e ON e.effective_status = keys.status GROUP BY 1")
def status_counts(spark, d):
    """A fixed set of statuses, zeros included."""
    keys = ["queued", "processing", "ready", "failed"]
    one = effective(spark, d).agg(*(F.count_if(F.col("effective_status") == k).alias(k) for k in keys))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("status"), F.col(k).alias("n")) for k in keys))))


@query(f"WITH {JOBS} SELECT status, count(*) AS n, count(*) FILTER (locked_at IS NOT NULL) AS locked, max(attempt) AS most FROM jobs GROUP BY 1")
def status_tally(spark, d):
    return jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("locked_at").isNotNull()).alias("locked"), F.max("attempt").alias("most"))


@query(f"WITH {JOBS}, h AS (SELECT * FROM jobs JOIN orders ON o_orderkey = id WHERE status = 'processing') SELECT 0::BIGINT AS claimed, 0::BIGINT AS completed, count(*) FILTER (attempt < 3) AS failed, count(*) FILTER (attempt >= 3) AS dead_lettered FROM h")
def worker_metrics(spark, d):
    before = jobs(spark, d)
    return Q.worker_metrics(before, Q.fail(before, asked(spark, d), NOW))


def cache(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    chunks = F.when(i % 5 > 0, F.transform(F.sequence(F.lit(1), (i % 7 + 1).cast("int")), lambda k: k + i)).otherwise(F.array().cast("array<bigint>"))
    return e.select(i.alias("cache_key"), (F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("expires_at"), (F.col("user_id") % 3).cast("int").alias("retrieval_version"), chunks.alias("chunks"), (i % 4).cast("int").alias("hit_count"))


CACHE = "cache AS (SELECT event_id AS cache_key, ts + INTERVAL 1 DAY AS expires_at, CAST(user_id % 3 AS INTEGER) AS retrieval_version, CASE WHEN event_id % 5 > 0 THEN list_transform(range(1, event_id % 7 + 2), lambda k: k + event_id) ELSE [] END AS chunks, CAST(event_id % 4 AS INTEGER) AS hit_count FROM events)"


@query(f"""WITH {CACHE} SELECT cache_key, array_to_string(list_slice(chunks, 1, 3), ',') AS chunks FROM cache JOIN orders ON o_orderkey = cache_key WHERE retrieval_version = o_orderkey % 3 AND expires_at > {_M} AND len(chunks) > 0""")
def cache_read(spark, d):
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("cache_key"), (F.col("o_orderkey") % 3).cast("int").alias("retrieval_version"), F.lit(3).alias("top_k"))
    return S.cache_read(cache(spark, d), wanted, MID).withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@query(f"WITH {CACHE} SELECT cache_key, hit_count + CASE WHEN cache_key IN (SELECT o_orderkey FROM orders) AND retrieval_version = cache_key % 3 THEN 1 ELSE 0 END AS hit_count FROM cache")
def cache_touch(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_orderkey").alias("cache_key"), (F.col("o_orderkey") % 3).cast("int").alias("retrieval_version"))
    return S.cache_touch(cache(spark, d), hits.unionByName(hits), MID).select("cache_key", "hit_count")


@query("SELECT count(*) AS n FROM events")
def cache_invalidate(spark, d):
    return S.cache_invalidate(cache(spark, d))[1]


@query("""SELECT count(*) FILTER (ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15') AS expired, count(*) FILTER (ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15' AND user_id % 3 < 2) AS outdated FROM events""")
def cache_prune(spark, d):
    return S.prune(cache(spark, d), "2024-01-15", 2)[1]


@query("SELECT event_id AS key, CASE WHEN event_id % 10 = 0 THEN 0 ELSE user_id END AS hits FROM events")
def cache_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("hits"))
    new = e.where(F.col("key") % 10 == 0).select("key", F.lit(0).cast("long").alias("hits"))
    return S.upsert(e, new.unionByName(new), "key")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT event_id FROM events) AND o_orderpriority = '1-URGENT'")
def history_delete(spark, d):
    history = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("user_id"))
    return S.delete_own(history, table(spark, d, "events").select(F.col("event_id").alias("id")), "1-URGENT")[1]


LIMITED = """h AS (SELECT event_id AS hit_id, user_id AS bucket, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL),
w AS (SELECT hit_id, bucket, ts, r, ts AS start, 1::BIGINT AS n FROM h WHERE r = 1 UNION ALL
SELECT h.hit_id, h.bucket, h.ts, h.r, CASE WHEN w.start + INTERVAL 86400 SECOND <= h.ts THEN h.ts ELSE w.start END, CASE WHEN w.start + INTERVAL 86400 SECOND <= h.ts THEN 1 ELSE w.n + 1 END FROM w JOIN h ON h.bucket = w.bucket AND h.r = w.r + 1)"""
LIMITED_ROWS = f"""WITH RECURSIVE {LIMITED} SELECT hit_id, bucket, n AS request_count, n <= 20 AS allowed, greatest(20 - n, 0) AS remaining, greatest(CAST(ceil((epoch_us(start) + 86400000000 - epoch_us(ts)) / 1000000) AS BIGINT), 1) AS retry_after FROM w"""


@query(LIMITED_ROWS)
def rate_limit(spark, d):
    return S.rate_limit(table(spark, d, "events").select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("bucket"), "ts"), 20, 86_400)


@query(LIMITED_ROWS)
def rate_limit_sql(spark, d):
    """The limiter as a table function that SQL calls."""
    FT.register(spark)
    hits = table(spark, d, "events").select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("bucket"), F.expr("cast(ts as timestamp_ntz)").alias("ts"))
    hits.where("bucket is not null").createOrReplaceTempView("limited_hits")
    return spark.sql(FT.LIMIT.format(hits="limited_hits", most=20, seconds=86_400))


@query("""WITH x AS (SELECT doc_id, lang, sha256(text) AS sha256 FROM documents), e AS (SELECT DISTINCT sha256 FROM x WHERE lang = 'en')
SELECT min(doc_id) AS doc_id, sha256 || ':v1' AS idempotency_key FROM x WHERE coalesce(lang, '') <> 'en' AND sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM e WHERE sha256 IS NOT NULL) GROUP BY sha256""")
def create_documents(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return L.create_documents(x.where(english), x.where(~english))


@query("SELECT c_custkey AS document_id, CASE WHEN c_acctbal <= 0 THEN 2 ELSE 1 END AS ingestion_version FROM customer")
def requeue_failed(spark, d):
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") <= 0, "failed").otherwise("ready").alias("status"), F.lit(1).alias("ingestion_version"))
    return L.requeue_failed(x).select("document_id", "ingestion_version")


_KEY = "'queued' AS status, 0 AS attempt, sha256(CAST(c_custkey AS VARCHAR)) || ':v' || {} AS idempotency_key, " + f"{_M} AS created_at, {_M} AS updated_at"


def _versioned(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("document_id"), F.sha2(key.cast("string"), 256).alias("sha256"), F.when(F.col("c_acctbal") <= 0, "failed").otherwise("ready").alias("status"), (1 + key % 3).cast("int").alias("ingestion_version"))


def _rows(jobs):
    return jobs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query(f"""WITH x AS (SELECT doc_id, lang, sha256(text) AS sha256 FROM documents), e AS (SELECT DISTINCT sha256 FROM x WHERE lang = 'en')
SELECT min(doc_id) AS document_id, 'queued' AS status, 0 AS attempt, sha256 || ':v1' AS idempotency_key, {_M} AS created_at, {_M} AS updated_at FROM x WHERE coalesce(lang, '') <> 'en' AND sha256 IS NOT NULL AND sha256 NOT IN (SELECT sha256 FROM e WHERE sha256 IS NOT NULL) GROUP BY sha256""")
def created_jobs(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    return _rows(L.create_with_jobs(x.where(english), x.where(~english), MID)[1])


@query(f"SELECT c_custkey AS document_id, {_KEY.format('(2 + c_custkey % 3)')} FROM customer WHERE c_acctbal <= 0")
def requeued_jobs(spark, d):
    return _rows(L.requeue_with_jobs(_versioned(spark, d), MID)[1])


@query(f"SELECT c_custkey AS document_id, {_KEY.format('(2 + c_custkey % 3)')} FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1")
def bumped_jobs(spark, d):
    docs = _versioned(spark, d)
    asked = docs.where("document_id % 2 = 0").select("document_id", F.lit(2).alias("ingestion_version"))
    return _rows(L.bump_with_jobs(docs, asked, MID)[1])


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def history_list(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("user_id"), (F.col("o_custkey") % 5).alias("conversation_id"), F.col("o_orderdate").alias("created_at"))
    return S.history(rows, "1-URGENT", 50, 2).select("id", "created_at")


def _building(spark, d):
    docs = table(spark, d, "customer").withColumnRenamed("c_custkey", "document_id")
    rows = {"jobs": table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id")), "chunks": table(spark, d, "events").select(F.col("user_id").alias("document_id"))}
    return docs, rows, docs.where("c_mktsegment = 'BUILDING'")


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') SELECT (SELECT count(*) FROM g) AS documents,
(SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM g)) AS jobs, (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM g)) AS chunks""")
def delete_cascade(spark, d):
    return L.cascade_counts(*_building(spark, d))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_rest(spark, d):
    return L.cascade(*_building(spark, d))[1]["jobs"].select("o_orderkey")


@query("""SELECT 'unique' AS "check", (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'parent', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'o_totalprice', (SELECT count(*) FROM orders WHERE o_totalprice < 1000)""")
def constraint_checks(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), "o_totalprice")
    return L.validate(rows, "document_id", table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), {"o_totalprice": 1000})


@query(f"SELECT doc_id, {_T} AS updated_at, CAST(len(list_filter(regexp_split_to_array(lower(coalesce(source, '') || ' ' || coalesce(text, '') || ' ' || coalesce(lang, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents")
def write_stamps(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("context"))
    return L.stamped(rows, NOW).select("doc_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.size("tokens").alias("n_tokens"))


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 40)")
def missing_contracts(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_type", "name")
    return L.missing(p, p.where("p_size > 40"))
