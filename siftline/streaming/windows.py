"""Streams: windowed metrics, the limiter, sentences of answers as they are written, live cache entries. Each equals its batch twin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The end of a sentence: its mark, closing brackets or quotes, white space.
BOUNDARY = r"""[.!?][)"'»\]]*\s+"""


def metric_windows(events: DataFrame, width: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum of events (ts, event_type, value) by window and type; works on a table or a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    agg = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def alerts(windows: DataFrame, event_type: str, limit: float, runs: int = 1) -> DataFrame:
    """(window_start, n) of the windows in which an event type came oftener than the limit, `runs` windows in a row."""
    rows = windows.where(F.col("event_type") == event_type).withColumn("_over", (F.col("n") > limit).cast("int"))
    w = "over (order by window_start rows between {} preceding and current row)".format(runs - 1)
    return rows.withColumn("_sum", F.expr(f"sum(_over) {w}")).where(F.col("_sum") == runs).select("window_start", "n")


def _expiry(state, seconds: int | None) -> None:
    if seconds:
        state.setTimeoutDuration(1000 * seconds)


def limiter_stream(hits: DataFrame, most: int, seconds: int, expire: int | None = None) -> DataFrame:
    """The fixed-window limiter over a stream of (bucket, ts, hit_id): its state is a window's begin and count for each bucket.
    With expire, a bucket's state goes when it has had no hit for so many seconds (two windows, say)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (0, 0)
        for b in batches:
            b = b.sort_values(["ts", "hit_id"])
            counts = []
            for t in b["ts"].astype("datetime64[ns]").astype("int64"):
                if not n or start + seconds * 1_000_000_000 <= t:
                    start, n = int(t), 0
                n += 1
                counts.append(n)
            yield pd.DataFrame({"hit_id": b["hit_id"], "bucket": key[0], "request_count": counts, "allowed": [c <= most for c in counts]})
        state.update((start, n))
        _expiry(state, expire)

    return hits.groupBy("bucket").applyInPandasWithState(run, "hit_id long, bucket long, request_count long, allowed boolean", "start long, n long", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


def sentences(deltas: DataFrame) -> DataFrame:
    """(answer_id, n, sentence) of whole answers from their parts (answer_id, seq, delta): what ends in a mark and white space,
    then the rest. The parts of one answer are gathered; they are bounded by a model's output."""
    whole = deltas.groupBy("answer_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "delta"))).delta, "").alias("t"))
    parts = F.regexp_extract_all("t", F.lit(rf"(?s).*?{BOUNDARY}|.+\z"), F.lit(0))
    return whole.select("answer_id", F.posexplode(F.filter(parts, lambda x: F.trim(x) != "")).alias("n", "sentence"))


def sentence_stream(deltas: DataFrame, expire: int | None = None) -> DataFrame:
    """The same from a stream of (answer_id, seq, delta, done): a sentence comes out as soon as it has ended, the rest with the
    part that is done. Its state is the unfinished text and the number of sentences so far, for each answer; with expire, that
    of an answer that was never done goes after so many seconds."""
    ends = re.compile(rf"(?s).*?{BOUNDARY}")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        text, out = text + "".join(rows["delta"]), []
        while m := ends.match(text):
            out.append(m[0])
            text = text[m.end() :]
        if rows["done"].any() and text:
            out.append(text)
            text = ""
        out = [x for x in out if x.strip()]
        yield pd.DataFrame({"answer_id": key[0], "n": range(n, n + len(out)), "sentence": out})
        if rows["done"].any():
            state.remove()
        else:
            state.update((text, n + len(out)))
            _expiry(state, expire)

    return deltas.groupBy("answer_id").applyInPandasWithState(run, "answer_id long, n int, sentence string", "text string, n int", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


def live_entries(cache: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Entries (cache_key, written_at, expires_at) of a table or stream that hadn't expired when they were written, each key once
    within the watermark."""
    rows = cache.where(F.col("expires_at") > F.col("written_at"))
    return rows.withWatermark("written_at", late).dropDuplicatesWithinWatermark(["cache_key"]) if cache.isStreaming else rows.dropDuplicates(["cache_key"])
