"""Streams with state that expires: the limiter, the retrieval cache and the memo of decompositions, as stateful processors.

Time is the events' own: the watermark is the clock. A timer stands where a window, an entry or a memo ends, and takes its state
out of the store when the watermark passes it; by then it can change no answer, so each stream equals its batch twin as long
as events aren't later than the watermark allows. The session needs the RocksDB state store, see `prepared`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 64  # of the memo, each with an even share of its entries


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _ms(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def _frame(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order."""
    return pd.concat(list(rows)).sort_values(list(order))


class _Timed(StatefulProcessor):
    """Keeps one timer where the state of a key ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def ends(self, at: int | None) -> None:
        for t in list(self.handle.listTimers()):
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Limiter(_Timed):
    """A window's begin in milliseconds and its count, for each bucket."""

    def __init__(self, most: int, seconds: int):
        self.most, self.width = most, 1000 * seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        b = _frame(rows, "ts", "hit_id")
        start, n = self.window.get() if self.window.exists() else (0, 0)
        counts, begins, times = [], [], _ms(b["ts"])
        for t in times:
            if not n or start + self.width <= t:
                start, n = t, 0
            n += 1
            counts.append(n)
            begins.append(start)
        self.window.update((int(start), n))
        self.ends(int(start) + self.width)
        left = pd.Series(begins, index=b.index) + self.width - times
        out = pd.DataFrame({"hit_id": b["hit_id"], "bucket": key[0], "request_count": counts})
        yield out.assign(allowed=out["request_count"] <= self.most, remaining=(self.most - out["request_count"]).clip(lower=0), retry_after=(-(-left // 1000)).clip(lower=1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())


def limiter(hits: DataFrame, most: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The fixed-window limiter over a stream of hits (bucket, ts, hit_id): the rows of operators.state.rate_limit. A bucket's state
    goes when its window has ended. Times count in milliseconds."""
    rows = hits.where("bucket is not null").select(F.col("bucket").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.col("hit_id").cast("long"))
    schema = "hit_id long, bucket long, request_count long, allowed boolean, remaining long, retry_after long"
    return rows.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(Limiter(most, seconds), schema, "Append", "EventTime")


class Cache(_Timed):
    """An entry for each key: payload, version, when it expires, how often it was hit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.entry = handle.getValueState("entry", "payload string, version int, expires long, hits long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        entry, out = (self.entry.get() if self.entry.exists() else None), []
        b = _frame(rows, "ts", "event_id")
        for t, r in zip(_ms(b["ts"]), b.itertuples(), strict=True):
            if r.kind == "put":
                entry = (r.payload, int(r.version), int(t + 1000 * r.ttl), 0)
                continue
            hit = entry is not None and entry[1] == r.version and entry[2] > t
            if hit:
                entry = (*entry[:3], entry[3] + 1)
            out.append((r.event_id, key[0], hit, entry[0] if hit else None, entry[3] if hit else 0))
        if entry is not None:
            self.entry.update(entry)
            self.ends(entry[2])
        yield pd.DataFrame(out, columns=["event_id", "cache_key", "hit", "payload", "hit_count"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())


CACHE_EVENTS = ("event_id", "cache_key", "ts", "kind", "payload", "version", "ttl")


def cache_stream(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(event_id, cache_key, hit, payload, hit_count) of each get among a stream of events (event_id, cache_key, ts, kind put or
    get, payload, version, ttl in seconds): the rows of cache_reads. An entry leaves the state when it has expired."""
    rows = events.where("cache_key is not null").select(*CACHE_EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late).groupBy("cache_key").transformWithStateInPandas(Cache(), "event_id long, cache_key string, hit boolean, payload string, hit_count long", "Append", "EventTime")


def cache_reads(events: DataFrame) -> DataFrame:
    """The batch twin: each get sees the last put before it, by time and event_id, if that has its version and hasn't expired; its
    hits count from that put."""
    key = Window.partitionBy("cache_key").orderBy("ts", "event_id")
    put = F.when(F.col("kind") == "put", F.struct(F.col("event_id").alias("id"), "payload", "version", (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("ttl"))).alias("expires")))
    rows = events.where("cache_key is not null").select(*CACHE_EVENTS).withColumn("_put", F.last(put, ignorenulls=True).over(key)).where("kind = 'get'")
    rows = rows.withColumn("hit", F.coalesce((F.col("_put.version") == F.col("version")) & (F.col("_put.expires") > F.col("ts").cast("timestamp")), F.lit(False)))
    n = F.sum(F.col("hit").cast("long")).over(Window.partitionBy("cache_key", "_put.id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", "cache_key", "hit", F.when(F.col("hit"), F.col("_put.payload")).alias("payload"), F.when(F.col("hit"), n).otherwise(0).cast("long").alias("hit_count"))


class Memo(_Timed):
    """Values by key in each shard, with when they expire and in which order they came."""

    def __init__(self, seconds: int, most: int):
        self.ttl, self.most = 1000 * seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.values = handle.getMapState("values", "key string", "value string, expires long, place long")
        self.next = handle.getValueState("next", "place long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        place = self.next.get()[0] if self.next.exists() else 0
        held = {k[0]: tuple(v) for k, v in self.values.iterator()}  # `most` entries at most
        before, out = dict(held), []
        b = _frame(rows, "ts", "event_id")
        for t, r in zip(_ms(b["ts"]), b.itertuples(), strict=True):
            own = held.get(r.key)
            cached = own is not None and own[1] > t
            if not cached:
                for k in [k for k, v in held.items() if v[1] <= t]:
                    del held[k]
                if len(held) >= self.most:
                    del held[min(held, key=lambda k: held[k][2])]
                held[r.key] = own = (r.value, int(t) + self.ttl, place)
                place += 1
            out.append((r.event_id, cached, own[0]))
        for k in before.keys() - held.keys():
            self.values.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.values.updateValue((k,), v)
        self.next.update((place,))
        self.ends(max((v[1] for v in held.values()), default=None))
        yield pd.DataFrame(out, columns=["event_id", "cached", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        self.next.clear()
        return iter(())


def memo_stream(calls: DataFrame, seconds: int, most: int = 500, shards: int = SHARDS, late: str = "0 seconds") -> DataFrame:
    """(event_id, cached, value) of a stream of calls (event_id, key, ts, value): the value that the memo has, or the call's own,
    which it then keeps for so many seconds. Keys fall into shards with an even share of `most` entries (one at least); a full
    shard drops what has expired, then the entry that came first. A shard's state goes when its last entry has expired."""
    rows = calls.where("key is not null").select("event_id", "key", F.col("ts").cast("timestamp").alias("ts"), "value", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    return rows.withWatermark("ts", late).groupBy("shard").transformWithStateInPandas(Memo(seconds, max(1, most // shards)), "event_id long, cached boolean, value string", "Append", "EventTime")
