"""The language of a text is detected once, however many steps read it."""

from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.operators import chunking as K


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_results_read_what_was_detected(spark):
    rows = spark.createDataFrame([(1, 0, "the cat and the dog for us"), (1, 1, "xyz"), (None, 2, "abc")], "doc_id long, section int, text string")
    done = K.section_languages(rows)
    assert "regexp_count" not in _plan(done) and "replace" not in _plan(done)
    assert {(r.section, r.language) for r in done.collect()} == {(0, "EN"), (1, "EN"), (2, "EN")}
    chunks = rows.select(F.col("section").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("section").alias("ord"), F.lit("").alias("title"), F.col("text").alias("content"), F.lit("DE").alias("language"))
    changed = K.backfill_languages(chunks, chunks.select("document_id").distinct().withColumn("language", F.lit(None).cast("string")))
    assert "regexp_count" not in _plan(changed) and "replace" not in _plan(changed)
    assert {(r.chunk_id, r.new, r.reason) for r in changed.collect()} == {(0, "EN", "detected"), (1, "EN", "inherited")}


def test_keywords_are_counted_without_overlaps(spark):
    texts = ["und und und", "der die das", " für  für ", "UND the", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.keyword_count(F.col("t"), "DE")).collect()]
    want = [None if t is None else sum((" " + t.lower() + " ").count(k) for k in X.LANGUAGE_KEYWORDS["DE"]) for t in texts]
    assert got == want
