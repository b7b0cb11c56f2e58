"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The shared folder where a session on one machine names none, as in tests.
OWN_DIR = "/tmp/checkpoints"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which a cluster must name."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or OWN_DIR).rstrip('/')}/siftline-core/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: computed once, and there after executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
