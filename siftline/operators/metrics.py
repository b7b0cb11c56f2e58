"""Aggregates over results: percentiles of three sorts, embedding drift, retrieval metrics, gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import vector as V
from siftline.functions.columns import few
from siftline.sources.shared import kept


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {c})")


def linear(c: str, p: float) -> Column:
    return F.expr(f"percentile_cont({p}) within group (order by {c})")


#: Rows of a segment that are sorted in one task at most, unless they are all equal; rounds of cutting segments at most.
SEGMENT, ROUNDS = 100_000, 8


def at_ranks(df: DataFrame, c: str, by: str, ranks: Column, bins: int = 4096, most: int = SEGMENT) -> DataFrame:
    """(by, n, rank, value): the values of c at the ranks (from 0) that the column `ranks` makes of n, the number of values of
    the group in ascending order. Nulls are left out; NaN is above all numbers.

    A group is a segment of values first. Each round counts a segment's values in bins and keeps the bins that hold a wanted
    rank; one that is still crowded is a segment of the next round, from its least to its greatest value, so that neither a
    large group nor an outlier puts many rows into one task. The first round's bins are even on a logarithmic scale, for
    both signs; ties collapse to a count."""
    rows = df.where(F.col(c).isNotNull()).select(F.col(by).alias("_g"), F.col(c).alias("_v"))
    found = final_segments(rows, ranks, bins, most)
    held = F.col("_g").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))
    values = rows.join(few(found.select(F.col("_g").alias("_k"), "_lo", "_hi", "_before"), F.lit(64)), held).groupBy("_k", "_lo", "_before", "_v").agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy("_k", "_before").orderBy("_v")) + F.col("_before")
    values = values.withColumn("_end", end).select("_k", F.col("_before").alias("_b"), "_v", (F.col("_end") - F.col("_c")).alias("_start"), "_end")
    wanted = found.select("_g", "n", "_before", F.explode("ranks").alias("rank"))
    at = wanted.join(values, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_before") == F.col("_b")) & (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_end")))
    return at.select(F.col("_g").alias(by), "n", "rank", F.col("_v").alias("value"))


def final_segments(rows: DataFrame, ranks: Column, bins: int = 4096, most: int = SEGMENT) -> DataFrame:
    """(_g, n, _lo, _hi, _before, _rows, ranks): parts of each group's values (_g, _v) that hold the wanted ranks, of `most` rows or of
    one value each, with how many values come before them."""
    ends = rows.groupBy("_g").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_rows"))
    ranked = ends.withColumn("n", F.col("_rows")).withColumn("ranks", F.array_distinct(ranks.cast("array<bigint>")))
    todo = kept(ranked.select("_g", "n", "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"), "_rows", "ranks"), "segments")
    crowded = (F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))
    done = todo.where(~crowded)
    for turn in range(ROUNDS):
        todo = todo.where(crowded)
        if todo.isEmpty():
            return done
        # On the first scale all numbers lie within 711 of 0; infinities and NaN stand beyond its ends.
        x = lambda v: F.when(F.isnan(v.cast("double")), 801.0).otherwise(F.least(F.greatest(F.asinh(v.cast("double")), F.lit(-800.0)), F.lit(800.0))) if not turn else v.cast("double")  # noqa: B023, E731
        width = x(F.col("_hi")) - x(F.col("_lo"))
        bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((x(F.col("_v")) - x(F.col("_lo"))) / width * bins).cast("int"))).otherwise(0)
        segments = todo.select(F.col("_g").alias("_k"), "_lo", "_hi", F.col("_before").alias("_s"))
        inside = rows.join(few(segments, F.lit(64)), F.col("_g").eqNullSafe(F.col("_k")) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy("_k", "_s", bin_.alias("_bin")).agg(F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        end = F.sum("_rows").over(Window.partitionBy("_k", "_s").orderBy("_bin")) + F.col("_s")
        counts = counts.withColumn("_before", end - F.col("_rows"))
        wanted = todo.select("_g", "n", F.col("_before").alias("_t"), F.explode("ranks").alias("rank"))
        here = F.col("_g").eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_t")) & (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_rows"))
        todo = kept(wanted.join(counts, here).groupBy("_g", "n", "_lo", "_hi", "_before", "_rows").agg(F.collect_set("rank").alias("ranks")), "segments")
        done = done.unionByName(todo.where(~crowded))
    return done.unionByName(todo.where(crowded))


def floor_rank(df: DataFrame, c: str, p: float, by: str) -> DataFrame:
    """The value at index floor((n-1)*p) of each group in ascending order."""
    return at_ranks(df, c, by, F.array(F.floor((F.col("n") - 1) * p))).select(by, "value")


def percentile_table(df: DataFrame, c: str, by: str, nearest: dict[str, float], interpolated: dict[str, float]) -> DataFrame:
    """by and a column for each name: nearest-rank percentiles (index ceil(p n) - 1) and linear ones (position p (n - 1))."""
    n = F.col("n")
    near = {k: F.greatest(F.lit(0).cast("bigint"), F.ceil(p * n) - 1) for k, p in nearest.items()}
    spot = {k: p * (n - 1) for k, p in interpolated.items()}
    ranks = F.array(*(x.cast("bigint") for x in near.values()), *(f(x).cast("bigint") for x in spot.values() for f in (F.floor, F.ceil)))
    got = at_ranks(df, c, by, ranks).groupBy(by, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    at = lambda x: F.element_at("_m", x.cast("bigint"))
    line = lambda x: at(F.floor(x)) + (at(F.ceil(x)) - at(F.floor(x))) * (x - F.floor(x))
    return got.select(by, *(at(x).alias(k) for k, x in near.items()), *(line(x).alias(k) for k, x in spot.items()))


def centroid(vectors: DataFrame, by: str) -> DataFrame:
    """Element-wise means (by, pos, mean): partial sums leave each task, one row for each position."""
    return vectors.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def snapshot(vectors: DataFrame, by: str) -> DataFrame:
    """Norm statistics by group and overall (null), in one pass."""
    n = vectors.select(F.col(by).cast("string").alias("grp"), F.size("embedding").alias("dim"), V.norm(F.col("embedding")).alias("norm"))
    return n.rollup("grp").agg(F.count("*").alias("n"), F.max("dim").alias("dim"), F.count_if(F.col("norm") == 0).alias("zero"), F.count_if(F.col("norm") < 1e-6).alias("near_zero"), F.round(F.avg("norm"), 6).alias("norm_mean"), F.round(F.stddev_pop("norm"), 6).alias("norm_std"))


def embedding_snapshot(vectors: DataFrame, by: str) -> DataFrame:
    """A snapshot with a centroid (array<double>) for each group and overall (grp null), and the overall p95 of the norms.
    Vectors of no or different dimensions are an error."""
    grp = F.col(by).cast("string").alias("grp")
    sizes = vectors.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    checked = F.when((F.col("lo") != F.col("hi")) | (F.col("lo") <= 0), F.raise_error(F.lit("embeddings of no or different dimensions"))).otherwise(F.col("hi"))
    points = vectors.select(grp, F.posexplode("embedding").alias("pos", "x")).withColumn("grp", F.explode(F.array("grp", F.lit("\x00all"))))
    means = points.groupBy("grp", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c")).select(F.when(F.col("grp") != "\x00all", F.col("grp")).alias("grp"), F.col("_c.m").alias("centroid"))
    norms = vectors.select(F.lit("all").alias("_k"), V.norm(F.col("embedding")).alias("norm"))
    p95 = floor_rank(norms, "norm", 0.95, "_k").select(F.round("value", 6).alias("norm_p95"))
    stats = snapshot(vectors, by).drop("dim").crossJoin(sizes.select(checked.alias("dim"))).crossJoin(p95)  # one row each
    centres = centres.withColumnRenamed("grp", "_g")
    return stats.join(centres, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "n", "dim", "zero", "near_zero", "norm_mean", "norm_std", F.when(F.col("grp").isNull(), F.col("norm_p95")).alias("norm_p95"), "centroid")


def ratio_delta(current: Column, baseline: Column) -> Column:
    return F.when(baseline == 0, F.when(current == 0, 0.0).otherwise(1.0)).otherwise(F.abs(current - baseline) / baseline)


# How far embeddings may drift.
DRIFT = {"samples": 100, "language_samples": 25, "zero": 0.0, "near_zero": 0.01, "norm_mean": 0.15, "norm_std": 0.25, "centroid": 0.08, "language_centroid": 0.12}


def drift_checks(current: DataFrame, baseline: DataFrame | None, languages: tuple[str, ...]) -> DataFrame:
    """(name, passed): the checks of a snapshot against a baseline; without one, that it can be adopted."""
    t = DRIFT
    whole = current.where("grp is null")
    one = lambda name, passed: F.struct(F.lit(name).alias("name"), passed.alias("passed"))
    rate = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    base = [one("sample_size_sufficient", F.col("n") >= t["samples"]), one("zero_vectors_absent", rate("zero") <= t["zero"]), one("near_zero_vectors_within_limit", rate("near_zero") <= t["near_zero"])]
    if baseline is None:
        return whole.select(F.inline(F.array(*base, one("baseline_present", F.lit(True)))))
    old = baseline.select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns))
    far = V.cosine_distance(F.col("centroid"), F.col("b_centroid"))
    more = [
        one("embedding_dimension_consistent", F.col("dim") == F.col("b_dim")), one("norm_mean_drift_within_limit", ratio_delta(F.col("norm_mean"), F.col("b_norm_mean")) <= t["norm_mean"]),
        one("norm_stddev_drift_within_limit", ratio_delta(F.col("norm_std"), F.col("b_norm_std")) <= t["norm_std"]), one("centroid_drift_within_limit", far <= t["centroid"]),
    ]
    overall = whole.crossJoin(old.where("b_grp is null")).select(F.inline(F.array(*base, *more)))  # one row each
    both = current.join(old, F.col("grp") == F.col("b_grp")).where(F.col("grp").isin(*languages) & (F.least("n", "b_n") >= t["language_samples"]))
    each = both.select(F.concat(F.lit("language_"), F.lower("grp"), F.lit("_centroid_drift_within_limit")).alias("name"), (far <= t["language_centroid"]).alias("passed"))
    return overall.unionByName(each)


def retrieval_metrics(results: DataFrame, expected: DataFrame) -> DataFrame:
    """recall@5, MRR and nDCG@10 of each query, from results (query_id, chunk_id, ord) and expected (query_id, chunk_id)."""
    want = expected.select("query_id", "chunk_id").distinct()
    return _retrieval(results.join(want, ["query_id", "chunk_id"]), want.groupBy("query_id").agg(F.count("*").alias("n")))


def labelled_metrics(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """retrieval_metrics where each of queries (query_id, label) expects all chunks (chunk_id, label) of its label. Pairs of a query
    and a chunk are made of the results alone; what a query expects is counted by label, unless it has several."""
    queries, chunks = (df.where("label is not null").distinct() for df in (queries, chunks))
    found = results.select("query_id", "chunk_id").distinct().join(queries, "query_id").join(chunks, ["chunk_id", "label"]).select("query_id", "chunk_id").distinct()
    kinds = queries.groupBy("query_id").agg(F.count("*").alias("_labels"), F.min("label").alias("label"))
    sizes = chunks.groupBy("label").agg(F.count("*").alias("n"))
    several = queries.join(kinds.where("_labels > 1").select("query_id"), "query_id", "left_semi").join(chunks, "label").select("query_id", "chunk_id").distinct()
    n = kinds.where("_labels = 1").join(sizes, "label").select("query_id", "n").unionByName(several.groupBy("query_id").agg(F.count("*").alias("n")))
    return _retrieval(results.join(found, ["query_id", "chunk_id"]), n)


def _retrieval(hit: DataFrame, n: DataFrame) -> DataFrame:
    """The figures from the results that were expected, and (query_id, n), how many are."""
    got = hit.groupBy("query_id").agg(F.min("ord").alias("first"), F.sum(F.when(F.col("ord") <= 10, 1 / F.log2(F.col("ord") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.greatest(F.lit(1), F.col("n").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(got, "query_id", "left").select("query_id", F.coalesce((F.col("first") <= 5).cast("int"), F.lit(0)).alias("recall_at_5"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg_at_10"))


def gates(summary: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One row for each limit (metric: '>=' or '<=', value) on a one-row summary; a missing metric fails."""
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("bound"), F.coalesce(F.col(m) >= v if op == ">=" else F.col(m) <= v, F.lit(False)).alias("passed")) for m, (op, v) in limits.items()))
    return summary.select(F.inline(rows))


def slice_statistics(df: DataFrame, c: str, by: str) -> DataFrame:
    """Count, extremes, linear quartiles and p90, and mean of c in each slice; nulls are left out."""
    ends = df.where(F.col(c).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"))
    marks = percentile_table(df, c, by, {}, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return ends.join(marks.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "least", "p25", "p50", "p75", "p90", "most", "mean")


def calibration_slices(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(slice, stat, n, least, p25, p50, p75, p90, most, mean): how the best relevance and the mean of the first three spread among
    answerable questions and unanswerable ones that were refused or answered. results: (query_id, question_type, insufficient);
    chunks: (query_id, ord from 1, relevance). Questions without chunks are left out; an empty slice has no row."""
    first = chunks.where("ord <= 3").groupBy("query_id").agg(F.max(F.when(F.col("ord") == 1, F.col("relevance"))).alias("top1"), F.avg("relevance").alias("top3mean"))
    outcome = F.when(F.col("question_type") != "unanswerable", "answerable").when(F.col("insufficient"), "unanswerable_abstained").otherwise("unanswerable_answered")
    rows = results.select("query_id", outcome.alias("slice")).join(first, "query_id").unpivot(["query_id", "slice"], ["top1", "top3mean"], "stat", "value")
    figures = slice_statistics(rows.withColumn("_key", F.concat_ws("|", "slice", "stat")), "value", "_key")
    return figures.select(F.substring_index("_key", "|", 1).alias("slice"), F.substring_index("_key", "|", -1).alias("stat"), "n", "least", "p25", "p50", "p75", "p90", "most", "mean")


def separation(df: DataFrame, c: str, answerable: Column, above: float = 0.02, below: float = 0.01, strict: bool = False) -> DataFrame:
    """One row: the highest c of unanswerable rows, the lowest of answerable ones, and the threshold between them (null where
    they overlap or a side is empty; an error instead, if strict)."""
    ends = df.agg(F.max(F.when(~answerable, F.col(c))).alias("unanswerable_max"), F.min(F.when(answerable, F.col(c))).alias("answerable_min"))
    clear = F.when(F.col("unanswerable_max") < F.col("answerable_min"), F.least(F.col("unanswerable_max") + above, F.col("answerable_min") - below))
    return ends.withColumn("threshold", F.coalesce(clear, F.raise_error(F.lit("no threshold separates the slices")).cast("double")) if strict else clear)


def even_sample(df: DataFrame, by: str, order: str, least: int = 3, most: int = 10, share: int = 6) -> DataFrame:
    """Evenly spaced rows (by, order) of each group: k = ceil(n / share), between least and most; those at floor(i * n / k).
    order is a number."""
    n = F.col("n")
    k = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n / share)))
    ranks = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.floor(i * n / k))
    return at_ranks(df, order, by, ranks).select(by, F.col("value").alias(order)).distinct()


def growth(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """By event_type: counts of the last `days`, of as many days before, and the difference."""
    end, span = F.lit(now).cast("timestamp"), F.expr(f"make_interval(0, 0, 0, {days})")
    ts = F.col("ts").cast("timestamp")
    out = events.groupBy("event_type").agg(F.count_if((ts > end - span) & (ts <= end)).alias("current"), F.count_if((ts > end - span - span) & (ts <= end - span)).alias("previous"))
    return out.withColumn("growth", F.col("current") - F.col("previous"))


DUPLICATE = r"(?i)(duplicate key value violates unique constraint|document_chunks_document_id_chunk_index_key)"


def soak(jobs: DataFrame, now: str, hours: int = 24, lock_seconds: int = 900) -> DataFrame:
    """One row on a window of jobs (status, updated_at, locked_at, last_error, processing_duration_ms): completed ones and the
    p95 of their durations, ones stuck beyond the lock, dead letters now and in the window before, duplicate writes."""
    end = F.lit(now).cast("timestamp")
    hours_ = lambda n: F.make_interval(hours=F.lit(n))
    recent = F.col("updated_at") >= end - hours_(hours)
    earlier = ~recent & (F.col("updated_at") >= end - hours_(2 * hours))
    s = F.col("status")
    done = (s == "completed") & recent
    rows = jobs.withColumns({"_k": F.lit(0), "_ms": F.when(done & (F.col("processing_duration_ms") > 0), F.col("processing_duration_ms"))})
    p95 = percentile_table(rows, "_ms", "_k", {"p95_completion_ms": 0.95}, {}).select("_k", "p95_completion_ms")
    stuck = (s == "processing") & (F.col("locked_at").isNull() | (F.col("locked_at") <= end - F.make_interval(secs=F.lit(lock_seconds))))
    one = rows.agg(F.lit(0).alias("_k"), F.count_if(done).alias("completed"), F.count_if(stuck).alias("stuck"), F.count_if((s == "dead_letter") & recent).alias("dead_now"), F.count_if((s == "dead_letter") & earlier).alias("dead_before"), F.count_if(recent & F.col("last_error").rlike(DUPLICATE)).alias("duplicate_writes"))
    return one.join(p95, "_k", "left").drop("_k").withColumn("dead_growth", F.col("dead_now") - F.col("dead_before"))


def health_checks(snapshot: DataFrame, queue_limit: int = 50) -> DataFrame:
    """(name, passed) of the eight health checks on a runtime snapshot (see queue.runtime_snapshot)."""
    c = F.col
    tests = {
        "queue_backlog_within_limit": c("queued_count") <= queue_limit, "stale_processing_jobs_absent": c("stale_processing_count") == 0, "processing_jobs_heartbeating_recently": c("lagging_processing_count") == 0,
        "cron_progress_present_when_queue_exists": (c("queued_count") == 0) | (c("recent_progress_count") > 0), "processing_documents_match_active_jobs": c("inconsistent_document_count") == 0,
        "ready_documents_have_chunks": c("ready_without_chunks_count") == 0, "processing_jobs_have_locks": c("processing_without_lock_count") == 0, "non_processing_jobs_are_unlocked": c("non_processing_with_lock_count") == 0,
    }
    return snapshot.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("passed")) for k, v in tests.items()))))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the rows' lines, a line feed between them."""
    digest, between = hashlib.sha256(), b""
    for b in batches:
        for x in b.column(0).to_pylist():
            digest.update(between + x.encode())
            between = b"\n"
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["fingerprint"])


def corpus_fingerprint(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (fingerprint): SHA-256 of a line for each ready document, by id: id, number of its chunks, newest of them in ISO
    form. documents (document_id, status), chunks (document_id, created_at). A digest in order is one pass: one task sorts
    the lines, on disk where they are many, and hashes them as they come, in constant memory."""
    g = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.max("created_at").alias("at"))
    line = F.concat_ws(":", F.col("document_id").cast("string"), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("none")))
    rows = documents.where("status = 'ready'").select("document_id").join(g, "document_id", "left").select("document_id", line.alias("x"))
    one = rows.repartition(1).sortWithinPartitions("document_id").select("x").mapInArrow(_digest, "fingerprint string")
    return one.agg(F.coalesce(F.max("fingerprint"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def merged_counts(branches: DataFrame) -> DataFrame:
    """Candidate counts (query_id, vector, keyword, fused, reranked) of a query's branches, summed."""
    return branches.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("vector", "keyword", "fused", "reranked")))
