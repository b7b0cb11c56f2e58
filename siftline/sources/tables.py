"""Tables, text sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siftline.operators.state import STATUS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ingestion jobs, a document for each user; some locks are half there or left behind."""
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("event_type")]
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    locked = (F.col("event_type") == "view") | ((F.col("event_type") == "purchase") & (i % 11 == 0))
    stage = F.when(i % 5 == 0, "embedding").when(i % 5 == 1, "storing").when(i % 5 == 2, "  ").when(i % 5 == 4, "extracting")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("document_id"), status.alias("status"), F.pmod(i, F.lit(5)).cast("int").alias("attempt"), ts.alias("created_at"),
        F.when(locked, ts).alias("locked_at"), F.when(locked & (i % 9 != 0), F.concat(F.lit("w"), F.pmod("user_id", F.lit(7)))).alias("locked_by"),
        (ts + F.make_interval(mins=(i % 7).cast("int"))).alias("updated_at"), stage.alias("current_stage"),
    )


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def json_rows(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """A JSON array column as rows with their ordinal; what isn't valid gives no row."""
    return df.select("*", F.posexplode(F.from_json(column, f"array<struct<{ddl}>>")).alias("ordinal", "_v")).select(*df.columns, "ordinal", "_v.*")


CHUNK = "chunk_index int, page_number int, section_title string, content string, context string, language string, embedding array<double>, extraction_method string, embedding_model string, token_count int"


def chunk_rows(df: DataFrame, column: str) -> DataFrame:
    """Chunks in a JSON array column as rows: the index defaults to the place from 0, the page to 1, the language to EN, texts
    to empty ones; empty titles, methods and models are null. A null column gives no row."""
    rows = json_rows(df, column, CHUNK)
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    default = {"chunk_index": F.col("ordinal"), "page_number": F.lit(1), "content": F.lit(""), "context": F.lit(""), "language": F.lit("EN"), "embedding": F.array().cast("array<double>")}
    put = {c: F.coalesce(c, v) for c, v in default.items()} | {c: empty(c) for c in ("section_title", "extraction_method", "embedding_model")}
    return rows.withColumns(put).drop("ordinal", column)


def most_recent(df: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows, ties by key: a top-k, which each task cuts before they meet."""
    return df.orderBy(F.desc(at), key).limit(n)


def web_sources(results: DataFrame, least: float = 0.5, most: int = 500) -> DataFrame:
    """Search results (url, content, score) by http or https of enough relevance, with a snippet of their content."""
    kept = results.where(F.col("url").rlike(r"(?i)^https?://") & (F.col("score") >= least))
    return kept.withColumn("snippet", F.left("content", F.lit(most)))


def numbers(c: Column, default: float = 0.0) -> Column:
    """A number, or the default where it is null or not a number."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(default))


def append(df: DataFrame, path: str) -> int:
    """Appends df and returns how many rows it wrote; df is computed once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def append_events(events: DataFrame, path: str, address: str | None = None) -> int:
    """Appends metric events (metric_name, value, tags map, ...), with the address they came from among their tags."""
    if address is not None:
        events = events.withColumn("tags", F.map_concat(F.coalesce("tags", F.create_map().cast("map<string,string>")), F.create_map(F.lit("ingestedFromIp"), F.lit(address))))
    return append(events, path)


def replace_documents(df: DataFrame, path: str) -> DataFrame:
    """Replaces the documents that df (document_id, ...) has, and no other: one partition of the target for each. Returns one
    row (deleted, inserted)."""
    spark = df.sparkSession
    ids = df.select("document_id").distinct()
    try:
        before = spark.read.parquet(path).join(ids, "document_id", "left_semi").count()
    except AnalysisException:  # nothing is there yet
        before = 0
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)
    return spark.createDataFrame([(before, seen.get["n"])], "deleted long, inserted long")


def json_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, ddl: str, whole: bool = False) -> DataFrame:
    """JSON artifacts by their schema: an object in each line, or whole files."""
    return spark.read.schema(ddl).option("multiLine", whole).json(path)
