"""Streams against their batch twins, ingestion, sources and sinks, SQL functions."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftline.functions import sql
from siftline.operators import chunking as K
from siftline.operators import evaluation as V
from siftline.operators import metrics as A
from siftline.operators import ranking as R
from siftline.sources import tables as T
from siftline.streaming import ingest, windows

BEGIN = datetime(2024, 1, 1)


def drained(spark, stream, name, path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_sentences_as_they_come(spark, tmp_path):
    texts = {1: 'One. Two (2.) "Three!" and the rest', 2: "no end", 3: "A? B! C."}
    rnd, rows = random.Random(1), []
    for k, t in texts.items():
        cuts = sorted({0, len(t), *(rnd.randrange(len(t)) for _ in range(5))})
        rows += [(k, i, t[a:b], b == len(t)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    schema = "answer_id long, seq int, delta string, done boolean"
    for i in range(max(r[1] for r in rows) + 1):  # a part of each answer in every file
        spark.createDataFrame([r for r in rows if r[1] == i], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in drained(spark, windows.sentence_stream(stream), "sentences", tmp_path / "cp"))
    want = sorted(tuple(r) for r in windows.sentences(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(want) == 8


def test_metric_windows_and_entries(spark, tmp_path):
    rows = [(BEGIN + timedelta(minutes=i), "error" if i % 3 else "view", float(i)) for i in range(100)] + [(BEGIN + timedelta(days=2), "view", 0.0)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(spark, windows.metric_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "metrics", tmp_path / "cp")}
    want = {tuple(r) for r in windows.metric_windows(df.where("ts < '2024-01-02'")).collect()}
    assert got == want and len(want) == 14
    keys = spark.createDataFrame([(i % 5, BEGIN + timedelta(seconds=i), BEGIN + timedelta(seconds=10)) for i in range(20)], "cache_key int, written_at timestamp, expires_at timestamp").coalesce(1)
    keys.write.parquet(str(tmp_path / "keys"))
    live = drained(spark, windows.live_entries(spark.readStream.schema(keys.schema).parquet(str(tmp_path / "keys"))), "entries", tmp_path / "cp2")
    assert {r.cache_key for r in live} == {r.cache_key for r in windows.live_entries(keys).collect()} == set(range(5)) and len(live) == 5


def test_ingestion(spark, tmp_path):
    schema = "doc_id long, page int, text string"
    text = "OVERVIEW\n" + "the report and the plan for this year with more of it. " * 8
    for i, rows in enumerate([[(1, 1, text), (2, 1, "  ")], [(3, 1, text), (3, 2, "DETAILS\n" + text), (1, 1, "again")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    job = ingest.Ingestion(str(tmp_path / "state"), packer=K.Packer(60, 10, 20))
    job.start(stream, str(tmp_path / "cp")).awaitTermination()
    last = 1_000_000
    jobs = {r.document_id: (r.status, r.attempt, r.locked_by) for r in job.state(spark, "jobs", ingest.JOBS, last).collect()}
    assert jobs == {1: ("completed", 1, None), 2: ("processing", 2, "stream"), 3: ("completed", 1, None)} or jobs[2][0] in ("failed", "processing")
    docs = {r.document_id: (r.status, r.language) for r in job.state(spark, "documents", ingest.DOCUMENTS, last).collect()}
    assert docs[1] == ("ready", "EN") and docs[3] == ("ready", "EN") and docs[2][0] in ("queued", "processing")
    chunks = job.chunks(spark)
    assert {r.document_id for r in chunks.select("document_id").distinct().collect()} == {1, 3} and chunks.where("size(embedding) = 64").count() == chunks.count()
    before = chunks.count()
    job.run(spark.createDataFrame([(3, 1, text), (3, 2, "DETAILS\n" + text), (1, 1, "again")], schema), 1, "2024-05-01 00:00:00")  # the batch once more
    assert job.chunks(spark).count() == before


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([("m", 1.0, {"a": "b"}), ("m", 2.0, None)], "metric_name string, value double, tags map<string,string>")
    assert T.append_events(rows, path, "10.0.0.1") == 2 and T.append(rows, path) == 2
    assert spark.read.parquet(path).where("tags['ingestedFromIp'] = '10.0.0.1'").count() == 2
    docs = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "document_id long, chunk_index int, content string")
    out = str(tmp_path / "chunks")
    assert tuple(T.replace_documents(docs, out).first()) == (0, 3)
    assert tuple(T.replace_documents(docs.where("document_id = 1 and chunk_index = 0"), out).first()) == (2, 1)
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["a", "c"]
    T.json_report(docs, str(tmp_path / "report"))
    assert T.read_json(spark, str(tmp_path / "report"), "document_id long, content string").count() == 3
    (tmp_path / "x.bin").write_bytes(b"%PDF-1")
    assert [bytes(r.content) for r in T.blobs(spark, str(tmp_path / "x.bin")).collect()] == [b"%PDF-1"]
    assert V.report([{"metric": "a|b", "value": 0.5}], "R").splitlines()[-1] == "| a b | 0.5 |"


def test_chunk_rows(spark):
    payload = json.dumps([{"content": "x"}, {"chunk_index": 9, "page_number": 3, "section_title": "", "language": "DE", "embedding": [1, 2], "token_count": 4}])
    rows = T.chunk_rows(spark.createDataFrame([(1, payload), (2, None), (3, "broken")], "doc long, p string"), "p").orderBy("chunk_index").collect()
    assert [(r.doc, r.chunk_index, r.page_number, r.section_title, r.content, r.language, r.embedding) for r in rows] == [(1, 0, 1, None, "x", "EN", []), (1, 9, 3, None, "", "DE", [1.0, 2.0])]


def test_sql_functions(spark):
    names = sql.register(spark)
    assert sql.missing(spark, [*names, "not_there"]) == ["not_there"]
    r = spark.sql("""select language_text_search_config('DE') a, language_text_search_config(null) b, build_keyword_query('The of Plan, plan') c, is_admin('{"app_metadata":{"role":"admin"}}') d, is_reader_or_admin('{}') e, cosine_distance(array(1D, 0D), array(0D, 1D)) f""").first()
    assert tuple(r) == ("german", "english", ["the", "plan"], True, False, 1.0)


def test_ranks_like_a_list(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([None, float(rnd.randint(0, 9)), rnd.random() * 1e6])) for g in ("a", "b", None) for _ in range(rnd.randint(1, 400))] + [("c", 5.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r["rank"]): r.value for r in A.at_ranks(df, "v", "g", F.array(F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1), bins=16).collect()}
    for g in ("a", "b", "c", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert {k[1]: x for k, x in got.items() if k[0] == g} == {i: v[i] for i in {0, len(v) // 2, len(v) - 1}}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_vector_search_in_parts(spark, monkeypatch, k):
    import numpy as np

    rnd = np.random.default_rng(4)
    x = rnd.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    monkeypatch.setattr(R, "QUERIES", 7)
    monkeypatch.setattr(R, "CHUNKS", 11)
    got = {}
    for r in R.vector_topk(df.where("id < 20").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), k).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.similarity))
    unit = np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    for q in range(20):
        sims = np.round(unit @ unit[q], 6)
        want = sorted(range(60), key=lambda i: (-sims[i], i))[:k]
        assert [c for c, _ in got[q]] == want
