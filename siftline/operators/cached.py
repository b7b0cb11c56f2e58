"""Retrieval behind its cache, for a whole batch: hits are read, each distinct miss is searched once, and the cache moves on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import retrieval as R
from siftline.operators import state as S
from siftline.providers import Providers
from siftline.sources.shared import kept

ROW = "ord int, chunk_id bigint, document_id bigint, page int, title string, content string, context string, language string, score double, rerank_score double, relevance double, scale string, source string, similarity double"
ENTRY = f"cache_key string, normalized_query string, language string, retrieval_version int, chunks array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>, hit_count int, created_at timestamp, expires_at timestamp, last_accessed_at timestamp"
_FIELDS = [x.split()[0] for x in ROW.split(", ")]
_TYPES = dict(x.split() for x in ROW.split(", "))


@dataclass(frozen=True)
class Retrieved:
    """rows: (query_id, and the fields of ROW); trace: (query_id, cache_key, normalized_query, language, cache_hit, n); cache: the
    cache as the batch leaves it."""

    rows: DataFrame
    trace: DataFrame
    cache: DataFrame


def keyed(queries: DataFrame, config: R.Config, version: int, top_k: int, namespace: str | None = None) -> DataFrame:
    """Prepared queries (query_id, text, and hint and scope, document ids, if given) with their cache_key and whether they ask
    for an overview of one document. Queries that are empty once normalised are left out."""
    q = R.prepared(queries).where("query <> ''")
    ids = F.array_sort(F.array_distinct(F.col("scope"))) if "scope" in queries.columns else F.array().cast("array<bigint>")
    q = q.withColumn("scope", F.coalesce(ids, F.array().cast("array<bigint>")))
    where = F.lit(namespace) if namespace else F.when(F.size("scope") > 0, F.concat(F.lit("docs:"), F.array_join(F.col("scope").cast("array<string>"), ","))).otherwise("scope:all")
    q = q.withColumn("overview", X.overview_intent(F.col("query"), F.col("scope")))
    where = F.concat(F.when(F.col("overview"), "overview-v2:").otherwise(""), where)
    return q.withColumn("cache_key", X.cache_key(F.col("query"), F.col("query_language"), F.lit(version), F.lit(top_k), where, F.lit(config.fingerprint())))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", *((F.col(c) if c in rows.columns else F.lit(None)).cast(_TYPES[c]).alias(c) for c in _FIELDS))


def searched(misses: DataFrame, chunks: DataFrame, config: R.Config, providers: Providers, top_k: int) -> DataFrame:
    """(query_id, fields of ROW): what the searches give for the misses, overviews of one document among them."""
    plain = misses.where("not overview").select("query_id", "text", F.col("query_language").alias("hint"))
    found = _shaped(R.retrieve(plain, chunks, config, providers, top_k))
    views = R.overview(misses.where("overview").select("query_id", "text", "scope"), chunks, max(top_k, config.least_chunks, 6))
    bodies = chunks.select("chunk_id", "page", "title", "context", "language")
    order = F.row_number().over(R.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    views = views.join(bodies, "chunk_id").withColumns({"ord": order, "relevance": F.col("score"), "rerank_score": F.col("score"), "scale": F.lit("heuristic"), "source": F.lit("overview")})
    return found.unionByName(_shaped(views.where(F.col("ord") <= top_k)))


def retrieve(queries: DataFrame, chunks: DataFrame, cache: DataFrame, now: str, config: R.Config | None = None, providers: Providers | None = None, version: int = 1, seconds: int = 3600, namespace: str | None = None) -> Retrieved:
    """The ranked chunks of queries (query_id, text, ...) over chunks, see retrieval.retrieve, and the cache (ENTRY) after it.

    Expired and outdated entries go first. A query whose key a live entry of this version has is answered by it, cut to top_k,
    and counts as a hit of it. All others are searched, queries of one key once, and give entries that live `seconds`; what is
    found empty is searched again the next time."""
    config, providers = config or R.Config(), providers or Providers()
    t, top_k = F.lit(now).cast("timestamp"), max(1, config.top_k)
    cache = kept(S.prune(cache, now, version)[0], "cache")
    q = kept(keyed(queries, config, version, top_k, namespace), "keyed")
    live = cache.where((F.col("retrieval_version") == version) & (F.size("chunks") > 0)).select("cache_key", F.slice("chunks", 1, top_k).alias("chunks"))
    hit = kept(q.select("query_id", "cache_key").join(live, "cache_key"), "hits")
    missed = kept(q.join(live.select("cache_key"), "cache_key", "left_anti"), "missed")
    one = missed.groupBy("cache_key").agg(F.min("query_id").alias("query_id")).select("query_id")
    new = kept(searched(missed.join(one, "query_id", "left_semi"), chunks, config, providers, top_k), "searched")
    owner = missed.select("query_id", "cache_key").join(missed.groupBy("cache_key").agg(F.min("query_id").alias("_own")), "cache_key").select("query_id", "_own")
    rows = hit.select("query_id", F.explode("chunks").alias("_c")).select("query_id", "_c.*")
    rows = kept(rows.unionByName(owner.join(new.withColumnRenamed("query_id", "_own"), "_own").select("query_id", *_FIELDS)), "rows")
    lists = new.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("chunks"))  # top_k of each query
    entries = lists.join(q.select("query_id", "cache_key", F.col("query").alias("normalized_query"), F.col("query_language").alias("language")), "query_id").select(
        "cache_key", "normalized_query", "language", F.lit(version).alias("retrieval_version"), "chunks", F.lit(0).alias("hit_count"), t.alias("created_at"), (t + F.make_interval(secs=F.lit(seconds))).alias("expires_at"), t.alias("last_accessed_at")
    )
    touched = hit.groupBy("cache_key").agg(F.count("*").cast("int").alias("_n"))
    after = cache.join(touched, "cache_key", "left").withColumns({"hit_count": F.col("hit_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.when(F.col("_n").isNotNull(), t).otherwise(F.col("last_accessed_at"))}).drop("_n")
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    trace = q.join(hit.select("query_id", F.lit(True).alias("_h")), "query_id", "left").join(n, "query_id", "left")
    trace = trace.select("query_id", "cache_key", F.col("query").alias("normalized_query"), F.col("query_language").alias("language"), F.coalesce("_h", F.lit(False)).alias("cache_hit"), F.coalesce("n", F.lit(0)).alias("n"))
    return Retrieved(rows, trace, kept(S.upsert(after, entries.select(after.columns), "cache_key"), "cache"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], ENTRY)
