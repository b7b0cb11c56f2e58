"""The vector index against the exact search, and vectors that can't be compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import ranking as R
from siftline.operators import vector_index as I

DATA = "/root/testdata/sf0.01/embeddings.parquet"
RND = np.random.default_rng(4)


@pytest.fixture(scope="module")
def clustered(spark):
    """A third of all vectors in one dense group, the others in twenty loose ones, and rows that have no place in an index."""
    centers = RND.standard_normal((21, 12)) * 2
    rows = [(i, (centers[0] + 0.05 * RND.standard_normal(12) if i % 3 == 0 else centers[1 + i % 20] + RND.standard_normal(12)).tolist()) for i in range(900)]
    odd = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] * 12), (None, [1.0] * 12), (2004, [float("inf")] + [0.0] * 11)]
    return spark.createDataFrame(rows + [(900, [0.0] * 12), (901, rows[5][1])] + odd, "chunk_id long, embedding array<float>").repartition(3)


def pairs(df):
    return {(r.query_id, r.ord): (r.chunk_id, r.similarity) for r in df.collect()}


def recall(got, want):
    have = {(r.query_id, r.chunk_id) for r in got.collect()}
    rows = want.collect()
    return sum((r.query_id, r.chunk_id) in have for r in rows) / len(rows)


def test_index_of_clusters(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PART", 50)
    monkeypatch.setattr(I, "BLOCK", 7)
    q = clustered.where("chunk_id % 9 = 0 or chunk_id is null or chunk_id >= 2000").withColumnRenamed("chunk_id", "query_id").unionByName(spark.createDataFrame([(5000, [1.0, 2.0])], "query_id long, embedding array<float>"))
    index = I.build(clustered, str(tmp_path / "index"), lists=30)
    assert index.counts.sum() == 902
    want = R.vector_topk(q.where("query_id <> 5000"), clustered, 10)
    near = I.search(index, q, 10, probes=4)
    n = q.where("query_id < 2000").count()
    assert near.count() == 10 * n and recall(near, want) >= 0.9
    assert pairs(I.search(I.opened(spark, str(tmp_path / "index")), q, 10, probes=1, exact=True)) == pairs(want)
    # Lists that hold fewer vectors than wanted lead on to more lists.
    assert I.search(index, q, 400, probes=1).groupBy("query_id").count().where("count <> 400").isEmpty()


def test_scan_reads_probed_lists_alone(spark, clustered, tmp_path):
    index = I.build(clustered, str(tmp_path / "index"), lists=12)
    one = clustered.where("chunk_id = 3").withColumnRenamed("chunk_id", "query_id")
    plan = I._joined(index, one.withColumn("list", F.lit(0)), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:120]


def test_recall_on_the_test_table(spark, tmp_path):
    e = spark.read.parquet(DATA)
    rows = e.select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    index = I.build(rows, str(tmp_path / "index"))
    want = R.vector_topk(q, rows, 10)
    got = I.search(index, q, 10)
    found = recall(got, want)
    print("recall at 10:", found, "lists:", len(index.counts), "probed:", index.probes)
    assert got.count() == want.count() and found >= 0.9


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    index = I.build(none, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert I.search(index, q, 3).collect() == [] == R.vector_topk(q, none, 3).collect()


def test_exact_search_leaves_out_what_cannot_be_compared(spark, clustered):
    q = spark.createDataFrame([(1, None), (2, [1.0]), (3, []), (4, [1.0] * 12)], "query_id long, embedding array<float>")
    got = R.vector_topk(q, clustered, 3).collect()
    assert {r.query_id for r in got} == {4} and len(got) == 3
