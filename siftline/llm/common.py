"""Shared-folder tables and small helpers of the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The shared folder where a session on one machine names none, as in tests.
OWN_DIR = "/tmp/checkpoints"
#: White space as the tokenizers' regular expressions see it (the Unicode property).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a single machine. A cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or OWN_DIR).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/siftline/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: it cuts the lineage and outlives lost executors. With a path of one's
    own the table can be dropped (files.forget) when all that is made of it is kept as well."""
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of rows that may be sent to every task, summed up before; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def few(df: DataFrame, width: Column) -> DataFrame:
    """df, to be sent to every task if its rows of `width` bytes are within the bound."""
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of texts: a batch of very long documents must still fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)
