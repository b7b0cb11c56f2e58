"""Every registered query over a small table with nulls, ties, repeated rows and columns of clashing names."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from siftline.llm import common, langid, pii, registry, sketch  # noqa: E402

RND = random.Random(21)
EN = ["the", "house", "and", "river", "of", "stone", "with", "green", "light", "from", "this", "garden"]
DE = ["der", "haus", "und", "fluss", "mit", "stein", "grün", "licht", "aus", "dieser", "garten", "straße"]
text = lambda words, n: " ".join(RND.choice(words) for _ in range(n)).capitalize() + "."
DOCS = [(i, text(EN if i % 2 else DE, RND.choice([3, 20, 60])) + (f"\nshared line of words here {i % 3}" if i % 4 == 0 else ""), ("en" if i % 2 else "de") if i % 5 else None, "web", 1, "x", 0.5) for i in range(80)]
DOCS += [(80, None, "en", "web", 0, "x", 0.5), (81, "", None, "web", 0, "x", 0.5), (82, " \n ", "de", "web", 0, "x", 0.5), (None, "no id at all", "en", "web", 0, "x", 0.5), (7, DOCS[7][1], "en", "web", 0, "x", 0.5), (83, "12345 678", None, "web", 0, "x", 0.5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, score double"
PAGES = [(i, f"http://x/{i % 7}", "<p>" + "page " * (30 if i % 3 else 2) + str(i % 4) + "</p>") for i in range(40)] + [(40, None, None), (41, "http://y\nz", "<p>é</p>")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(DOCS, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0 * (i % 5), 0.5], 1) for i in range(30)] + [(None, [1.0, 2.0, 3.0], 1), (4, None, 1), (5, [None, 1.0, 1.0], 1)], "vec_id long, embedding array<float>, n int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2).write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def rows(spark, sf, name):
    return registry.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", ["op2_bpe", "op3_line_dedup", "op4_language_id", "op5_ngram_jaccard", "op6_fingerprints", "op7_pii", "op10_exact_dedup", "op11_simhash"])
def test_a_row_for_each_document(spark, sf, name):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in rows(spark, sf, name))
    assert got == sorted((x[0] is None, x[0] or 0) for x in DOCS)


def test_packing_covers_all_tokens(spark, sf):
    got = rows(spark, sf, "op1_packing")
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_language_query(spark, sf):
    got = rows(spark, sf, "op4_language_id")
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    pred = {r.doc_id: r.lang_pred for r in got}
    assert pred[80] == pred[81] == pred[82] == pred[83] == "und"
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 80]
    assert held and all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in held)


def test_language_never_sees_the_answer(spark):
    """Held-out labels, whatever they are, change no prediction."""
    flip = lambda x: (*x[:2], {"en": "de", "de": "en"}.get(x[2]) if langid.held_out(x[0]) else x[2], *x[3:])

    def predicted(data):
        df = spark.createDataFrame(data, SCHEMA)
        out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
        return sorted((r.doc_id or -1, r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df.where(~out))).collect())

    assert predicted(DOCS) == predicted([flip(x) for x in DOCS])


def test_language_like_a_plain_model(spark):
    """Known words by their log frequency, others by the longest n-grams that are known: against a plain version."""
    import math

    docs = [(x[0], x[1], x[2]) for x in DOCS if x[1] and x[2] and x[0] is not None]
    model = langid.fit(spark.createDataFrame([x for x in DOCS if x[0] is not None], SCHEMA))
    counts = {"de": {}, "en": {}}
    for _, t, lang in docs:
        for w in langid.words_of(t):
            counts[lang][w] = counts[lang].get(w, 0) + 1
    counts["en"]["house"] = counts["en"].get("house", 0)
    total = {k: sum(v.values()) for k, v in counts.items()}
    known = {w for v in counts.values() for w in v if sum(c.get(w, 0) for c in counts.values()) >= 2}
    for w in known:
        want = [math.log((counts[k].get(w, 0) + 0.5) / (total[k] + 0.5 * len(known) + 1)) for k in ("de", "en")]
        assert model.table[model.words[w]].tolist() == pytest.approx(want, abs=1e-4)
    assert langid.Scorer(model).predict("gartenhaus")[0] == "de" and langid.Scorer(model).predict("greenhouse")[0] == "en"


def plain_sketch(t):
    return sketch.bottom(sketch.Hasher()(t), sketch.K)


def test_fingerprint_query(spark, sf):
    order = sorted(DOCS, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    want = []
    for x, y in zip(order, order[1:] + order[:1], strict=True):
        a, b = x[1] or "", y[1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        s, e, n = plain_sketch(a), plain_sketch(edited), plain_sketch(b)
        want.append((x[0], len(a), hashlib.sha256(edited.encode()).hexdigest(), sketch.text_of(s), sketch.text_of(e), sketch.resemblance(s, e), sketch.resemblance(s, n), sketch.containment(s, e), sketch.containment(s, n), sketch.distinct(s)))
    got = [tuple(r) for r in rows(spark, sf, "op6_fingerprints")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_estimate(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(10_000)}" for _ in range(4000)]
    a, b = " ".join(words), " ".join(words[:3000])
    s, t = plain_sketch(a), plain_sketch(b)
    assert abs(sketch.resemblance(s, t) - 2996 / 3996) < 0.12 and abs(sketch.containment(t, s) - 1) < 0.15 and abs(sketch.distinct(s) - 3996) < 900
    parts = spark.createDataFrame([(1, " ".join(words[i : i + 1004])) for i in range(0, 4000, 1000)], "doc_id long, text string")
    whole = sketch.merged(sketch.fingerprints(parts), ["doc_id"]).first().sketch
    assert whole == plain_sketch(" ".join(words)).tolist()


def test_personal_data_beyond_the_patterns(spark):
    """Obfuscated addresses and national numbers with cue words are taken; version numbers and sums are not."""
    rnd = random.Random(3)
    data = [(i, f"write to user{i}@mail{i % 7}.example.com or call +1 (415) 555-{1000 + i} at {i % 200}.12.{i % 99}.7 today") for i in range(200)]
    data += [(1000 + i, f"please mail jane{i} [at] corp{i % 5}.com [dot] org and call (212) 555-{1000 + i} soon") for i in range(40)]
    data += [(2000 + i, f"the build 1.2.{i}.{300 + i} weighs {rnd.randrange(10**5)} kg, order 12345{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    done = {r.doc_id: r for r in pii.annotate(df, pii.fit(df)).collect()}
    assert all(len(done[i].base) == 3 for i in range(200)) and all(not done[1000 + i].base for i in range(40))
    found = sum(any(s.kind == "phone" for s in done[1000 + i].spans) for i in range(40))
    assert found == 40 and not any(done[2000 + i].spans for i in range(40))


def test_shared_folder_must_be_named(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session) == common.OWN_DIR


def test_packing_keeps_clashing_columns(spark):
    from siftline.llm import packing

    df = spark.createDataFrame([(1, 0, 10, "p", 3, "b"), (2, 0, 20, "q", 4, "c")], "doc_id long, start long, length long, part string, own int, base string").withColumn("row", F.lit(1)).withColumn("rank", F.lit("r")).withColumn("piece_hash", F.lit(2))
    got = packing.assign_sequences(df, 32).orderBy("doc_id").collect()
    assert [(r.part, r.own, r.base, r.row, r["rank"], r.piece_hash, r.sequence_id) for r in got] == [("p", 3, "b", 1, "r", 2, 0), ("q", 4, "c", 1, "r", 2, 0)]


def test_pipeline_with_odd_rows(spark, sf, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf)
        assert done.columns == docs.columns, name
        assert {(r.part, r.score) for r in done.collect()} <= {("x", 0.5)}, name
    assert corpus_pipeline.run(spark, empty).count() == 0
