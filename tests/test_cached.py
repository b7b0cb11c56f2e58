"""Retrieval behind its cache: hits equal what a search gives, each distinct miss is searched once, the cache moves on."""

from pyspark.sql import functions as F

from siftline.operators import cached as C
from siftline.operators import retrieval as R
from siftline.providers import HashedWords, Providers


def corpus(spark):
    texts = {1: "solar financing for schools in the north. It pays.", 2: "wind parks and permits of the state", 3: "solar panels on roofs. More text here.", 4: "budget of the year and the plan"}
    rows = [(i, i % 2, i, "", t, None, "EN") for i, t in texts.items()]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, page int, title string, content string, context string, language string")
    return df.withColumn("embedding", HashedWords().embed(F.col("content")))


def listed(rows):
    return sorted((r.query_id, r.ord, r.chunk_id, round(r.relevance, 9), r.content) for r in rows.collect())


def test_cache_moves_on(spark):
    chunks = corpus(spark)
    asked = [(1, "Solar  financing"), (2, "permits"), (3, "solar financing"), (4, "budget"), (5, "   "), (6, None)]
    q = spark.createDataFrame(asked, "query_id long, text string")
    first = C.retrieve(q.where("query_id < 3 or query_id > 4"), chunks, C.empty(spark), "2024-01-01 00:00:00", seconds=60)
    assert listed(first.rows) == listed(R.retrieve(q.where("query_id < 3"), chunks)) and {r.query_id: r.cache_hit for r in first.trace.collect()} == {1: False, 2: False}
    assert {r.normalized_query: (r.hit_count, len(r.chunks)) for r in first.cache.collect()} == {"solar financing": (0, 4), "permits": (0, 4)}

    class Counted(HashedWords):
        def embed(self, text):
            return super().embed(F.when(text.isin("solar financing", "permits"), F.raise_error(F.lit("searched again"))).otherwise(text))

    providers = Providers(embedding=Counted())
    second = C.retrieve(q, chunks, first.cache, "2024-01-01 00:00:59", providers=providers, seconds=60)
    assert {r.query_id: r.cache_hit for r in second.trace.collect()} == {1: True, 2: True, 3: True, 4: False}
    assert listed(second.rows) == listed(R.retrieve(q.where("query_id < 5"), chunks))
    assert {r.normalized_query: r.hit_count for r in second.cache.collect()} == {"solar financing": 2, "permits": 1, "budget": 0}
    # Entries expire, and those of an older version go.
    third = C.retrieve(q, chunks, second.cache, "2024-01-01 00:01:00", seconds=60)
    assert {r.query_id: r.cache_hit for r in third.trace.collect()} == {1: False, 2: False, 3: False, 4: True}
    assert {r.normalized_query: r.hit_count for r in third.cache.collect()} == {"solar financing": 0, "permits": 0, "budget": 1}
    fourth = C.retrieve(q, chunks, third.cache, "2024-01-01 00:01:01", version=2)
    assert not any(r.cache_hit for r in fourth.trace.collect()) and {r.retrieval_version for r in fourth.cache.collect()} == {2}


def test_scopes_and_overviews_have_keys_of_their_own(spark):
    chunks = corpus(spark)
    schema = "query_id long, text string, scope array<long>"
    q = spark.createDataFrame([(1, "summary", [1]), (2, "summary", [1, 1]), (3, "summary", [0, 1]), (4, "summary", None)], schema)
    got = C.retrieve(q, chunks, C.empty(spark), "2024-01-01")
    keys = {r.query_id: r.cache_key for r in got.trace.collect()}
    assert keys[1] == keys[2] and len(set(keys.values())) == 3
    rows = {}
    for r in got.rows.collect():
        rows.setdefault(r.query_id, []).append((r.ord, r.chunk_id, r.source))
    assert sorted(rows[1]) == sorted(rows[2]) == [(1, 1, "overview"), (2, 3, "overview")] and len(rows[3]) == len(rows[4]) == 4
    again = C.retrieve(q, chunks, got.cache, "2024-01-01")
    assert all(r.cache_hit for r in again.trace.collect()) and listed(again.rows) == listed(got.rows)
