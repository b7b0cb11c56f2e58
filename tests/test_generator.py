"""Generated evaluation questions: quotas, refills, and the run over them."""

from pyspark.sql import functions as F

from siftline.operators import evaluation as V
from siftline.operators import generator as G
from siftline.operators import retrieval as T
from siftline.providers import HashedWords


def chunks(spark, docs=5, each=9):
    words = ["solar", "river", "budget", "school", "permit", "garden", "engine", "harbour", "winter"]
    rows = [(100 * d + i, d, i, i + 1, f"Part {i}", (f"{words[i % 9]} number{d}x{i} in the report of the year. " * 8 if (d + i) % 7 else "short"), "EN" if d % 2 == 0 else "DE") for d in range(docs) for i in range(each)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, ord int, page int, title string, content string, language string")


class Fussy(G.PlainWriter):
    """Fails for some texts, and claims names that the corpus has in its first round."""

    def multi_hop(self, first, second):
        return F.when(~first.contains("x2 "), super().multi_hop(first, second))

    def unanswerable(self, language, n, turn):
        there = F.struct(F.lit("What is a garden?").alias("question"), F.array(F.lit("Garden")).alias("terms"))
        own = super().unanswerable(language, n, turn)
        return F.transform(own, lambda x, i: F.when((i % 2 == 0) | F.lit(turn == 0), there).otherwise(x))


def test_quotas_hold(spark):
    rows = chunks(spark).cache()
    got = G.generate(rows, targets={"EN": 5, "DE": 2, "FR": 0}).collect()
    by = {}
    for r in got:
        by.setdefault((r.question_type, r.language), []).append(r)
    assert len(by["unanswerable", "EN"]) == 5 and len(by["unanswerable", "DE"]) == 2 and ("unanswerable", "FR") not in by
    assert {r.id for r in by["unanswerable", "DE"]} == {"ua-de-1", "ua-de-2"} and all(r.chunk_ids == [] and r.points == [] for r in by["unanswerable", "EN"])
    assert len(by["multi_hop", "EN"]) == len(by["multi_hop", "DE"]) == G.PAIRS
    # Even samples of substantive chunks: three of each document here.
    whole = {r.chunk_id: r for r in rows.collect() if len(r.content.strip()) >= 200}
    for d in range(5):
        own = sorted(c for c, r in whole.items() if r.document_id == d)
        assert sorted(r.chunk_ids[0] for r in got if r.question_type == "single_hop" and r.document == d) == [own[i * len(own) // 3] for i in range(3)]
    assert len({r.id for r in got}) == len(got) and all(whole[c] for r in got for c in r.chunk_ids)
    again = G.generate(rows, targets={"EN": 5, "DE": 2}).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_what_falls_away_is_refilled(spark):
    rows = chunks(spark).cache()
    asked = G.unanswerable(rows, Fussy(), {"EN": 3}, rounds=4).collect()
    assert len(asked) == 3 and all("Zq" in r.question for r in asked) and len({r.question for r in asked}) == 3
    assert G.unanswerable(rows, Fussy(), {"EN": 3}, rounds=1).collect() == []
    pairs = G.multi_hop(rows, Fussy()).collect()
    tried = V.multi_hop_pairs(V.substantive(rows).select("document_id", "language", "ord", "chunk_id")).collect()
    usable = [(r.language, r.attempt, r.first) for r in tried if r.first % 100 != 2]
    want = {(k, c) for k in ("EN", "DE") for _, c in sorted((a, c) for g, a, c in usable if g == k)[: G.PAIRS]}
    assert {(r.language, r.chunk_ids[0]) for r in pairs} == want
    assert G.generate(rows.limit(0), targets={}).collect() == []


def test_benchmark_of_generated_questions(spark):
    rows = chunks(spark, docs=2, each=5)
    golden = G.golden(G.generate(rows, targets={"EN": 2})).cache()
    corpus = rows.withColumn("context", F.lit("")).withColumn("embedding", HashedWords().embed(F.col("content")))
    got = T.evaluated(golden, corpus).collect()
    assert len(got) == golden.count() and {r.question_type for r in got} == {"single_hop", "unanswerable"}
    single = [r for r in got if r.question_type == "single_hop"]
    assert all(r.recall_at_5 == 1 and r.mrr > 0 for r in single)
