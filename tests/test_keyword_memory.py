"""The keyword search holds a bounded part of the chunks, ranks texts as their index does, and counts words exactly."""

import tracemalloc
from collections import Counter

import pyarrow as pa

from siftline.operators import keyword_index as N
from siftline.operators import ranking as R

WORK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("text", pa.string()), ("grp", pa.int32()), ("config", pa.string()), ("positions", pa.list_(pa.int32()))])


def _batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(WORK.names, r, strict=True)) for r in rows], schema=WORK)


def _peak(chunks: int) -> int:
    def rows():
        yield _batch([(0, 0, 0, q, f"w{(q + i) % 50}", 0, None, []) for q in range(20) for i in range(5)])
        for begin in range(0, chunks, 1000):
            yield _batch([(0, 0, 1, c, f"w{i}", 0, None, [i + 1, 100 + i]) for c in range(begin, begin + 1000) for i in range(50)])

    tracemalloc.start()
    out = list(N._searched(rows(), 5, "entry"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 100
    return peak


def test_memory_does_not_grow_with_the_chunks():
    assert _peak(16_000) < 1.3 * _peak(4_000)


def test_texts_rank_as_their_index_does(spark, tmp_path):
    rows = [(1, "Alpha", "beta " * 300 + "gamma", None, "EN"), (2, None, "running runs beta the", "alpha", "EN"), (2, None, "gamma beta", None, "DE"), (3, "", "", None, None), (None, "alpha", "", None, "EN")]
    rows += [(4, None, " ".join(f"x{i}" for i in range(17_000)) + " alpha beta", None, "FR"), (5, None, "beta alpha", None, "EN")]
    chunks = spark.createDataFrame(rows, "chunk_id long, title string, content string, context string, language string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, "running the"), (4, "nothing"), (None, "alpha")], "query_id long, text string")
    N.build(chunks, str(tmp_path / "index"), shards=2)
    indexed = {tuple(r) for r in N.cover_topk(N.any_of(queries), N.opened(spark, str(tmp_path / "index")), 3).collect()}
    assert {tuple(r) for r in N.keyword_search(queries, chunks, 3).collect()} == indexed
    # Chunk 2 has two texts: each position counts once, whichever of them it is of: 1, 2, 3, 4 and 8.
    assert {(q, c): r for q, c, r, _ in indexed}[(2, 2)] == 0.5


def test_counted_words_with_null_and_repeated_ids(spark):
    docs = [(1, "red red blue"), (2, "red"), (2, "blue Blue"), (None, "red red red red"), (3, None), (4, "")]
    asked = [(1, "red"), (2, "blue red"), (None, "blue")]
    got = R.keyword_topk(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string"), 5).collect()
    want = {}
    for q, text in asked:
        count = Counter()
        for c, words in docs:
            count[c] += sum(w in text.split() for w in (words or "").lower().split())
        want |= {(q, c): round(n * 0.1, 6) for c, n in count.items() if n}
    assert {(r.query_id, r.chunk_id): r["rank"] for r in got} == want


def test_words_are_counted_without_a_row_for_each_word(spark):
    q, c = spark.createDataFrame([(1, "red")], "query_id long, text string"), spark.createDataFrame([(1, "red")], "chunk_id long, text string")
    plan = R.keyword_topk(q, c, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(" not in plan and "Join" not in plan
