"""Table functions called from SQL against the DataFrame forms, and the transactional event sink."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.functions import tables as T
from siftline.operators import answers as W
from siftline.operators import ranking as R
from siftline.operators import state as S
from siftline.sources import events as E


def test_rate_limit_in_sql(spark):
    T.register(spark)
    rnd = random.Random(1)
    begin = datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 2, 3, None]), begin + timedelta(milliseconds=rnd.randrange(60_000)), i) for i in range(300)]
    hits = spark.createDataFrame(rows, "bucket long, ts timestamp, hit_id long").repartition(3)
    hits.createOrReplaceTempView("hits")
    got = spark.sql(T.LIMIT.format(hits="hits", most=4, seconds=7)).collect()
    want = S.rate_limit(hits, 4, 7).select("hit_id", "bucket", "request_count", "allowed", "remaining", "retry_after").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.allowed for r in got} == {True, False}


@pytest.mark.parametrize("batch", [5, 1024])
def test_vector_search_in_sql(spark, batch, monkeypatch):
    monkeypatch.setattr(T, "BATCH", batch)
    T.register(spark)
    x = np.random.default_rng(2).integers(-2, 3, (80, 4)).astype(float).tolist()
    rows = spark.createDataFrame([*enumerate(x), (90, None), (91, [1.0])], "chunk_id long, embedding array<double>")
    q = rows.where("chunk_id < 9 or chunk_id = 90").withColumnRenamed("chunk_id", "query_id")
    rows.createOrReplaceTempView("chunks")
    q.createOrReplaceTempView("queries")
    got = spark.sql(T.MATCH.format(queries="queries", chunks="chunks", parts=3, k=6)).collect()
    want = R.vector_topk(q, rows, 6).select("query_id", "chunk_id", "similarity", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 54


def answers(spark, tmp_path):
    schema = "query_id long, answer string, outcome string"
    for i in range(3):
        spark.createDataFrame([(10 * i + k, f"Answer {k} é with some words. [1]" if k else "", "answered") for k in range(4)], schema).coalesce(2).write.parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    q = W.event_rows(stream).writeStream.format("answer_events").option("name", "api").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return E.committed(spark, out)


def test_events_appear_once_in_order(spark, tmp_path):
    spark.dataSource.register(E.AnswerEvents)
    stream = answers(spark, tmp_path)
    want = sorted(map(tuple, W.event_rows(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))).collect()))
    assert sorted(map(tuple, run(spark, stream, tmp_path).collect())) == want and len(want) > 60
    # The last micro-batch once more, as after a driver that was lost between its commit and the checkpoint's.
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (tmp_path / "cp" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, run(spark, stream, tmp_path).collect())) == want
    assert len(list((tmp_path / "out" / "_data").glob("*.json"))) == sum(len(E.json.loads(p.read_text())["files"]) for p in (tmp_path / "out" / "_log" / "api").glob("*.json"))
    body = {r.query_id: r.body for r in E.frames(run(spark, stream, tmp_path)).collect()}
    names = [x.split("\n")[0] for x in body[11].split("\n\n") if x]
    assert names[0] == "event: meta" and names[-2:] == ["event: final", "event: done"] and set(names[1:-2]) == {"event: token"}


def test_sink_refuses_disorder_and_forgets_what_failed(spark, tmp_path):
    w = E.AnswerEventsWriter(str(tmp_path), "x")
    rows = [{"query_id": 1, "seq": i, "event": "token", "data": "é"} for i in (0, 1)]
    with pytest.raises(ValueError):
        w.write(iter(rows[::-1]))
    kept = w.write(iter(rows))
    lost = w.write(iter(rows))
    w.abort([lost, None], 0)
    w.commit([kept, None, w.write(iter([]))], 0)
    assert E.committed(spark, str(tmp_path)).orderBy("seq").select(F.collect_list("data")).first()[0] == ["é", "é"]
    assert E.committed(spark, str(tmp_path / "nothing")).collect() == []
