"""Ingestion as a stream: pages arrive, jobs are queued, claimed and completed, chunks replaced, micro-batch by micro-batch.

State lies under one folder, a version of each table for each batch; a batch that is repeated after a failure reads the version
before it and writes its own anew, so nothing happens twice. One writer, as the micro-batches of a stream follow each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import chunking as K
from siftline.operators import queue as Q
from siftline.providers import Embedding, HashedWords

JOBS = "id long, document_id long, status string, attempt int, idempotency_key string, created_at timestamp, updated_at timestamp, locked_at timestamp, locked_by string, last_error string, current_stage string, processing_started_at timestamp, processing_duration_ms long"
DOCUMENTS = "document_id long, status string, language string, sha256 string, ingestion_version int, updated_at timestamp"


@dataclass
class Ingestion:
    """folder: of the state and of the chunks, a partition for each document."""

    folder: str
    worker: str = "stream"
    retries: int = 3
    batch: int = 1_000_000
    packer: K.Packer = field(default_factory=K.Packer)
    embedding: Embedding = field(default_factory=HashedWords)

    def state(self, spark: SparkSession, name: str, ddl: str, before: int) -> DataFrame:
        """The newest version of a table that a batch before this one wrote."""
        try:
            rows = spark.read.schema(f"{ddl}, batch long").parquet(f"{self.folder}/{name}")
        except AnalysisException:  # nothing is there yet
            return spark.createDataFrame([], ddl)
        last = rows.where(F.col("batch") < before).agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == (-1 if last is None else last)).drop("batch")

    def save(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/chunks")

    def run(self, pages: DataFrame, batch: int, now: str) -> None:
        """One micro-batch of pages (doc_id, page, text): the documents in it are queued, claimed, chunked, embedded and completed;
        those without any text fail."""
        spark, t = pages.sparkSession, Q.at(now)
        pages = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text")
        jobs, documents = self.state(spark, "jobs", JOBS, batch), self.state(spark, "documents", DOCUMENTS, batch)
        seen = pages.where("doc_id is not null").groupBy(F.col("doc_id").alias("document_id")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("page", "text")))), 256).alias("sha256"))
        new = seen.join(documents, "document_id", "left_anti").select("document_id", F.lit("queued").alias("status"), F.lit(None).cast("string").alias("language"), "sha256", F.lit(1).alias("ingestion_version"), t.alias("updated_at"))
        documents = self.save(documents.unionByName(new), "queued", batch)
        queued = Q.ensure(documents, jobs).select(F.col("document_id").alias("id"), "document_id", "status", "attempt", "idempotency_key", t.alias("created_at"), t.alias("updated_at"))
        jobs = Q.claim(jobs.unionByName(queued, allowMissingColumns=True), now, self.batch, retries=self.retries, worker=self.worker)
        jobs = self.save(jobs, "claimed", batch)
        mine = jobs.where((F.col("status") == "processing") & (F.col("locked_by") == self.worker) & (F.col("locked_at") == t)).select("id", F.col("document_id").alias("doc_id"))
        cut = K.chunk_documents(pages.join(mine.select("doc_id"), "doc_id", "left_semi"), packer=self.packer)
        text = K.embed_input(F.lit(""), F.col("title"), F.lit(""), F.col("content"))
        cut = self.save(cut.withColumn("embedding", self.embedding.embed(text)), "cut", batch)
        cut.withColumnRenamed("doc_id", "document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{self.folder}/chunks")
        done = mine.join(cut.select("doc_id").distinct(), "doc_id", "left_semi")
        failed = mine.join(done, "doc_id", "left_anti").withColumn("error", F.lit("no text could be extracted"))
        after = Q.fail(Q.complete(jobs, done, now), failed, now, self.retries)
        after = self.save(after, "jobs", batch)
        languages = K.mode_language(cut).select(F.col("doc_id").alias("document_id"), F.col("language").alias("_l"))
        documents = Q.propagate(documents, jobs, after, now).join(languages, "document_id", "left").withColumn("language", F.coalesce("_l", "language")).drop("_l")
        self.save(documents.select([x.split()[0] for x in DOCUMENTS.split(", ")]), "documents", batch)

    def start(self, pages: DataFrame, checkpoint: str, once: bool = True, every: str = "5 seconds"):
        """Runs over a stream of pages: all that is there and then ends, or on and on."""
        each = lambda df, batch: self.run(df, batch, str(df.sparkSession.sql("select current_timestamp()").first()[0]))
        out = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
