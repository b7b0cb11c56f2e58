"""Resumable ingestion: nothing lost or repeated when a run is killed, versions, failures, and what a batch costs."""

import time

from pyspark.sql import functions as F

from siftline.operators import chunking as K
from siftline.streaming import incremental as I

TEXT = "OVERVIEW\n" + "the report and the plan for this year with more of it. " * 60
PAGES = "doc_id long, page int, text string"


def until(query, done, seconds=90):
    end = time.time() + seconds
    while not done():
        assert query.isActive, query.exception()
        assert time.time() < end, query.lastProgress
        time.sleep(0.3)


def arrive(spark, job, folder, batches):
    for i, rows in batches.items():
        spark.createDataFrame(rows, PAGES).coalesce(1).write.parquet(f"{folder}/{i}")
    stream = spark.readStream.schema(PAGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    job.cut(stream).awaitTermination()


def test_killed_runs_resume(spark, tmp_path):
    job = I.Incremental(str(tmp_path / "state"), per_run=4, packer=K.Packer(60, 10, 20))
    arrive(spark, job, str(tmp_path / "in"), {0: [(1, 1, TEXT), (1, 2, "DETAILS\n" + TEXT), (2, 1, "  "), (None, 1, TEXT)], 1: [(3, 1, TEXT)]})
    want = {(r.doc_id, r.chunk_index): r.content for r in K.chunk_documents(spark.createDataFrame([(1, 1, TEXT), (1, 2, "DETAILS\n" + TEXT), (3, 1, TEXT)], PAGES), packer=job.packer).collect()}
    assert len(want) > 12
    q = job.embed(spark)
    until(q, lambda: q.lastProgress is not None and q.lastProgress["batchId"] >= 1)
    q.stop()  # in the middle
    written = job.chunks(spark).count()
    assert 0 < written < len(want)
    q = job.embed(spark)
    until(q, lambda: I.drained(q))
    got = job.chunks(spark).collect()
    assert len(got) == len(want) and {(r.document_id, r.chunk_index): r.content for r in got} == want and all(len(r.embedding) == 64 for r in got)
    docs = {r.document_id: (r.status, r.version, r.attempt, r.processed) for r in job.documents(spark).collect()}
    assert docs == {1: ("completed", 1, 1, sum(d == 1 for d, _ in want)), 2: ("failed", 1, 1, 0), 3: ("completed", 1, 1, sum(d == 3 for d, _ in want))}
    # No run writes more than per_run chunks of a document, and jobs in between are events.
    assert job.events(spark, "job").where("document_id = 1").count() == -(-docs[1][3] // 4)
    # The same again, a new version, and the document without text until it is given up.
    new = "CHANGED\n" + "other words for the second version of it. " * 40
    arrive(spark, job, str(tmp_path / "in"), {2: [(3, 1, TEXT), (1, 1, new), (2, 1, "  ")], 3: [(2, 1, "  ")]})
    until(q, lambda: (d := {r.document_id: r for r in job.documents(spark).collect()}) and d[1].version == 2 and d[1].status == "completed" and d[2].status == "dead_letter" and I.drained(q))
    q.stop()
    docs = {r.document_id: (r.status, r.version, r.attempt) for r in job.documents(spark).collect()}
    assert docs == {1: ("completed", 2, 1), 2: ("dead_letter", 1, 3), 3: ("completed", 1, 1)}
    again = [r.content for r in job.chunks(spark).where("document_id = 1").orderBy("chunk_index").collect()]
    assert again == [r.content for r in K.chunk_documents(spark.createDataFrame([(1, 1, new)], PAGES), packer=job.packer).orderBy("chunk_index").collect()]
    assert job.events(spark, "chunk").where("document_id = 3").count() == sum(d == 3 for d, _ in want)  # nothing of it twice


def test_candidates(spark):
    rows = I.candidates(spark.createDataFrame([(1, 1, TEXT), (2, 1, None), (None, 1, "x")], PAGES)).orderBy("document_id", "chunk_index").collect()
    assert {r.document_id for r in rows} == {1, 2} and rows[-1].chunk_index is None and rows[-1].total == 0 and rows[0].total == len(rows) - 1
    assert I.candidates(spark.createDataFrame([], PAGES)).collect() == []
