"""A vector index of inverted lists: a coarse quantiser, and the vectors of each of its cells as a partition of a Parquet table.

The quantiser is trained by k-means on a bounded sample; every vector is indexed, in the list of its nearest centroid. A query
probes the lists whose centroids are nearest to it, more of them if they hold fewer vectors than it wants, and the scan reads
only the lists that some query probes. An exact search then also probes every list that could still hold a better vector: no
vector of a list is closer to the query than the angle to the centroid minus the list's widest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import vector as V
from siftline.operators.ranking import _nearest, _unit, top, vector_topk
from siftline.sources.shared import kept

MOST_LISTS = 4096
TRAIN = 64  # sampled vectors for each list, which the quantiser is trained on
TRIED = 256  # sampled vectors that are searched exactly to find out how many lists a query must probe
FILE, PART, BLOCK = 250_000, 100_000, 20_000  # vectors in a file; vectors and queries of a list that one task joins
SLACK = 2e-6  # similarities are rounded to six places


@dataclass(frozen=True)
class VectorIndex:
    """Where the lists lie; of each list its centroid at length 1, how many vectors it has, and the least similarity of any of
    them to the centroid; and how many lists a query probes if it doesn't say."""

    path: str
    centroids: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    probes: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def unit(e: Column) -> Column:
    """A vector at length 1 in doubles; a zero vector stays zero."""
    norm = V.norm(e)
    return F.transform(e, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def train(vectors: DataFrame, lists: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Centroids of the TRAIN * lists vectors (chunk_id, embedding) that come first by a hash of their id."""
    sample = vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(TRAIN * lists)
    sample = kept(sample.select(unit(F.col("embedding")).alias("v")), "quantiser-sample").select(array_to_vector("v").alias("features"))
    centers = np.stack(KMeans(k=lists, seed=seed, maxIter=rounds).fit(sample).clusterCenters()) if lists > 1 else np.zeros((1, len(sample.first().features)))
    norms = np.linalg.norm(centers, axis=1, keepdims=True)
    return np.divide(centers, norms, out=np.zeros_like(centers), where=norms > 0)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sims = _unit(b.column(1), b.num_rows) @ centroids.T
        cell = sims.argmax(1) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sims[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))], ["chunk_id", "embedding", "closeness", "list"])


def _placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each query's lists with their places, the nearest first."""
    for b in batches:
        order = np.argsort(-(_unit(b.column(1), b.num_rows) @ centroids.T), axis=1, kind="stable")
        n = order.shape[1]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(order)), n))), pa.array(order.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(order)))], ["query_id", "list", "place"])


def calibrated(index: VectorIndex, vectors: DataFrame, k: int, recall: float, seed: int = 7) -> int:
    """How many lists the TRIED vectors that come first by a hash must probe to find so large a share of their k nearest
    neighbours, themselves left out, as an exact search over all vectors gives them."""
    spark = vectors.sparkSession
    tried = kept(vectors.orderBy(F.xxhash64("chunk_id", F.lit(seed + 1)), "chunk_id").limit(TRIED).select(F.col("chunk_id").alias("query_id"), "embedding"), "tried")
    truth = vector_topk(tried, vectors, k + 1).where("query_id <> chunk_id").select("query_id", "chunk_id")
    lists = index.rows(spark).join(F.broadcast(truth), "chunk_id").select("query_id", "list")  # TRIED * (k + 1) rows at most
    places = tried.mapInArrow(partial(_placed, centroids=index.centroids), "query_id long, list int, place int")
    found = lists.join(places, ["query_id", "list"]).agg(F.expr(f"percentile_disc({recall}) within group (order by place)"))
    place = found.first()[0]
    return 1 if place is None else int(place) + 1


def build(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 7, k: int = 10, recall: float = 0.96) -> VectorIndex:
    """Indexes vectors (chunk_id, embedding) under a path. Those without an id, and null, empty or unsound ones, are left out; all
    others must have one length. lists: by default the square root of their number, MOST_LISTS at most. Searches probe as many
    lists as a sample of the vectors needs for that share of its k nearest neighbours."""
    spark = vectors.sparkSession
    v = vectors.where("chunk_id is not null").where(V.sound(F.col("embedding"))).select(F.col("chunk_id").cast("long"), "embedding")
    lists = lists or min(MOST_LISTS, max(1, round(v.count() ** 0.5)))
    if v.isEmpty():
        centroids = np.zeros((1, 0))
    else:
        centroids = train(v, lists, seed)
    element = dict(v.dtypes)["embedding"]
    cells = v.mapInArrow(partial(_assigned, centroids=centroids), f"chunk_id long, embedding {element}, closeness double, list int")
    # Lists meet in one task each, but large ones are split by the optimizer, and files are of a bounded size.
    cells.hint("rebalance", "list").write.option("maxRecordsPerFile", FILE).partitionBy("list").parquet(f"{path}/lists")
    stats = spark.read.schema("closeness double, list int").parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"), F.min("closeness").alias("least"))
    sizes = {r.list: r for r in stats.collect()}  # MOST_LISTS rows at most
    own = VectorIndex(path, centroids, np.zeros(0), np.zeros(0))
    probes = calibrated(own, v, k, recall, seed) if sizes else 1
    rows = [(i, c.tolist(), sizes[i].n if i in sizes else 0, float(sizes[i].least) if i in sizes else 1.0, probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>, n long, least double, probes int").coalesce(1).write.parquet(f"{path}/quantiser")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/quantiser").orderBy("list").collect()
    return VectorIndex(path, np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1), np.array([r.n for r in rows]), np.array([r.least for r in rows]), rows[0].probes)


def _probes(batches: Iterator[pa.RecordBatch], index: VectorIndex, k: int, probes: int) -> Iterator[pa.RecordBatch]:
    """(query_id, embedding, list) from (query_id, embedding): the `probes` nearest lists that have vectors, and as many more as k
    vectors take. With a third column, the similarity that a query's k-th row has: instead, all other lists that could hold
    a vector as similar."""
    filled = np.flatnonzero(index.counts > 0)
    for b in batches:
        sims = _unit(b.column(1), b.num_rows) @ index.centroids[filled].T
        order = np.argsort(-sims, axis=1, kind="stable")
        total = np.cumsum(index.counts[filled][order], axis=1)
        before = np.concatenate([np.zeros((len(order), 1), np.int64), total[:, :-1]], 1)
        wanted = (np.arange(order.shape[1])[None, :] < probes) | (before < k)
        if b.num_columns > 2:
            angle = np.arccos(np.clip(np.take_along_axis(sims, order, 1), -1, 1)) - np.arccos(np.clip(index.least[filled][order], -1, 1))
            best = np.cos(np.clip(angle, 0, np.pi))
            wanted = ~wanted & (best >= b.column(2).to_numpy(zero_copy_only=False)[:, None] - SLACK)
        row, at = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(filled[order[row, at]].astype(np.int32))], ["query_id", "embedding", "list"])


def _joined(index: VectorIndex, probed: DataFrame, k: int) -> DataFrame:
    """The k best rows of each probe (query_id, embedding, list) and task; the scan reads the probed lists alone."""
    spark = probed.sparkSession
    asked = {r.list: r.n for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS rows at most
    shape = spark.createDataFrame([(i, -(-int(index.counts[i]) // PART), -(-n // BLOCK)) for i, n in asked.items()], "list int, parts int, blocks int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    shape = F.broadcast(shape)  # a row for each list
    left = probed.join(shape, "list").withColumn("block", mine("query_id", "blocks")).withColumn("p", each("parts")).select("list", "p", "block", F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("embedding").cast("array<double>"))
    there = index.rows(spark).where(F.col("list").isin(sorted(asked))).join(shape, "list").withColumn("p", mine("chunk_id", "parts")).withColumn("block", each("blocks"))
    right = there.select("list", "p", "block", F.lit(1).alias("side"), F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>"))
    work = left.unionByName(right).select((F.col("list").cast("long") * (1 << 32) + F.col("p")).alias("part"), "block", "side", "id", "embedding")
    return work.repartition("part", "block").sortWithinPartitions("part", "block", "side").mapInArrow(_nearest(k), "query_id long, chunk_id long, similarity double")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, chunk_id, similarity, ord): the k most similar vectors of each of queries (query_id, embedding) among the lists it
    probes; with exact, among all vectors. There are k rows for each query, or as many as are indexed. Queries without an
    id or with a null, empty or unsound vector, or one of another length than the index, have no rows."""
    spark, d = queries.sparkSession, index.centroids.shape[1]
    order = [F.desc("similarity"), F.col("chunk_id")]
    q = queries.where("query_id is not null").where(V.sound(F.col("embedding")) & (F.size("embedding") == d)).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    if not index.counts.sum():
        return spark.createDataFrame([], "query_id long, chunk_id long, similarity double, ord int")
    run = partial(_probes, index=index, k=k, probes=probes or index.probes)
    schema = "query_id long, embedding array<double>, list int"
    found = top(_joined(index, kept(q.mapInArrow(run, schema), "probes"), k), k, order)
    if not exact:
        return found
    found = kept(found.drop("ord"), "probed")
    kth = found.groupBy("query_id").agg(F.min("similarity").alias("kth"))
    more = kept(q.join(kth, "query_id").mapInArrow(run, schema), "more-probes")
    return top(found.unionByName(_joined(index, more, k)), k, order)
