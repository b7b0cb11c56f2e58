"""Resumable ingestion whose batches cost what they bring: documents are cut as they arrive, their chunks wait in the state store.

Two streams follow each other. The first cuts each micro-batch of pages into candidates, a folder for each batch. The second keeps
a document's job and its candidates as keyed state; each run embeds and writes the next few chunks of every open document, so
a large document goes on over many runs and a killed stream where its last committed run ended. No table is read or
written anew: chunks and job events are appended by the file sink, which counts a run's files once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from siftline.operators import chunking as K
from siftline.providers import Embedding, HashedWords
from siftline.streaming.state import prepared

CANDIDATE = "document_id long, sha256 string, total int, chunk_index int, page int, title string, content string, language string, n_tokens int"
EVENT = "kind string, document_id long, version int, chunk_index int, page int, title string, content string, language string, n_tokens int, status string, attempt int, processed int, total int"
_BODY = ("page", "title", "content", "language", "n_tokens")


def candidates(pages: DataFrame, packer: K.Packer | None = None) -> DataFrame:
    """Rows of CANDIDATE of pages (doc_id, page, text): the chunks of each document with its digest and how many there are; one row
    without an index for a document that gives none. Pages without a document are left out."""
    pages = pages.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text")
    seen = pages.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("page", "text")))), 256).alias("sha256"))
    cut = K.chunk_documents(pages, packer=packer)
    rows = seen.join(cut, "doc_id", "left")
    total = F.count("chunk_index").over(Window.partitionBy("doc_id")).cast("int")
    return rows.withColumn("total", total).select(F.col("doc_id").alias("document_id"), "sha256", "total", "chunk_index", *_BODY)


class Jobs(StatefulProcessor):
    """A document's job, and its candidates until they are written."""

    def __init__(self, per_run: int, retries: int):
        self.per_run, self.retries = per_run, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "sha256 string, version int, attempt int, status string, processed int, total int, first string")
        self.waiting = handle.getMapState("waiting", "i int", "page int, title string, content string, language string, n_tokens int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else None
        new = pd.concat(list(rows))
        for sha, own in new.groupby("sha256", sort=True):
            known = job is not None and job[0] == sha
            if known and job[3] not in ("failed",):  # the same document once more
                continue
            self.waiting.clear()
            own = own.drop_duplicates("chunk_index")
            total = int(own["total"].iloc[0])
            job = (sha, (job[1] if known else job[1] + 1) if job else 1, job[2] + 1 if known else 1, "processing", 0, total, None)
            for r in own[own["chunk_index"].notna()].itertuples():
                self.waiting.updateValue((int(r.chunk_index),), (int(r.page), r.title, r.content, r.language, int(r.n_tokens)))
        if job is not None and job[3] == "processing":
            yield self.advanced(key[0], job, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else None
        if job is not None and job[3] == "processing":
            yield self.advanced(key[0], job, timerValues)

    def advanced(self, document: int, job: tuple, timers: TimerValues) -> pd.DataFrame:
        """The next chunks of a job, and an event of what it has come to; a timer goes on with the rest in the next run."""
        sha, version, attempt, _, done, total, first = job
        upto, out = min(done + self.per_run, total), []
        for i in range(done, upto):
            body = self.waiting.getValue((i,))
            first = body[3] if first is None else first
            out.append(("chunk", document, version, i, *body, None, None, None, None))
            self.waiting.removeKey((i,))
        status = "completed" if total and upto == total else "processing" if total else "dead_letter" if attempt >= self.retries else "failed"
        self.job.update((sha, version, attempt, status, upto, total, first))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if status == "processing":
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1)
        out.append(("job", document, version, None, None, None, None, first, None, status, attempt, upto, total))
        whole = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        return whole.astype({c: "Int32" for c in ("chunk_index", "page", "n_tokens", "attempt", "processed", "total")})

    def close(self) -> None:
        pass


@dataclass
class Incremental:
    """folder: of candidates, results and checkpoints. per_run: chunks of a document that a run embeds. A document that gives no
    chunks fails, and is given up when it has come `retries` times."""

    folder: str
    per_run: int = 5
    retries: int = 3
    packer: K.Packer = field(default_factory=K.Packer)
    embedding: Embedding = field(default_factory=HashedWords)

    def cut(self, pages: DataFrame, once: bool = True, every: str = "5 seconds") -> StreamingQuery:
        """The first stream: a batch that is repeated replaces its own folder."""

        def each(batch: DataFrame, n: int) -> None:
            candidates(batch, self.packer).write.mode("overwrite").parquet(f"{self.folder}/candidates/batch={n}")

        out = pages.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint-cut")
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()

    def embed(self, spark: SparkSession, every: str = "1 second", files: int = 1000) -> StreamingQuery:
        """The second stream, which runs on; see drained. A document's candidates lie in one file, so they arrive together."""
        prepared(spark)
        rows = spark.readStream.schema(CANDIDATE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(f"{self.folder}/candidates")
        events = rows.groupBy("document_id").transformWithStateInPandas(Jobs(self.per_run, self.retries), EVENT, "Append", "ProcessingTime")
        text = K.embed_input(F.lit(""), F.col("title"), F.lit(""), F.col("content"))
        events = events.withColumn("embedding", F.when(F.col("kind") == "chunk", self.embedding.embed(text)))
        events = events.observe("ingestion", F.count_if((F.col("kind") == "job") & (F.col("status") == "processing")).alias("open"))
        return events.writeStream.partitionBy("kind").format("parquet").option("path", f"{self.folder}/events").option("checkpointLocation", f"{self.folder}/checkpoint-embed").outputMode("append").trigger(processingTime=every).start()

    def events(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.schema(EVENT.removeprefix("kind string, ") + ", embedding array<double>, kind string").parquet(f"{self.folder}/events").where(F.col("kind") == kind)

    def documents(self, spark: SparkSession) -> DataFrame:
        """(document_id, version, status, attempt, processed, total, language) as the last event of each document has it."""
        last = F.max_by(F.struct("status", "processed", "total", "language"), F.struct("version", "attempt", "processed")).alias("_e")
        order = F.max(F.struct("version", "attempt")).alias("_v")
        return self.events(spark, "job").groupBy("document_id").agg(last, order).select("document_id", "_v.version", "_e.status", "_v.attempt", "_e.processed", "_e.total", "_e.language")

    def chunks(self, spark: SparkSession) -> DataFrame:
        """The chunks written so far of each document's newest version."""
        return self.events(spark, "chunk").join(self.documents(spark).select("document_id", "version"), ["document_id", "version"], "left_semi").drop("kind", "status", "attempt", "processed", "total")


def drained(query: StreamingQuery) -> bool:
    """Whether the last run read nothing and left no document open."""
    p = query.lastProgress
    seen = (p and p["observedMetrics"] or {}).get("ingestion")
    return seen is not None and p["numInputRows"] == 0 and seen["open"] == 0
