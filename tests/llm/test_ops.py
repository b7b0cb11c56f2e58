import random
import re
import struct
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from siftline.llm import blocks, bpe, exact_dedup, graph, langid, line_dedup, ngram_join, packing, pii, shards, sketch, tokens, warc  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RND = random.Random(7)
VOCAB = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(300)]
BASE = " ".join(RND.choice(VOCAB) for _ in range(120))
ODD = [None, "", "   ", "A  b\n\n  c \t", "Hello World", "hello world", "x", "naïve café — ½ 漢字 🙂  <|endoftext|> tail ", "a\r\n b c  ", "don't WE'LL 1234", BASE, BASE.upper(), BASE, BASE.replace(VOCAB[3], "zz"), BASE + " end", "long " * 5000]
ROWS = [(i, t, "src", 1) for i, t in enumerate(ODD)] + [(4, "Hello World", "src", 1)]
SCHEMA = "doc_id long, text string, keep_id string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(spark, docs, none):
    t = tokens.load(BYTE)
    got = bpe.decode(bpe.encode(docs, BYTE, block=2000), BYTE).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = ODD[r.doc_id] or ""
        want = t.encode(text, add_special_tokens=False).ids
        assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0


def test_packing(spark, docs, none):
    t = tokens.load(WORD)
    got = packing.assign_sequences(packing.token_pieces(docs, WORD, capacity=64), 64, salt_rows=5).collect()
    seqs, per_doc = {}, {}
    for r in got:
        ids = [*t.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(seqs) == list(range(len(seqs)))
    assert packing.assign_sequences(packing.token_pieces(none, WORD)).count() == 0


def test_best_fill_is_the_best():
    rnd = random.Random(3)
    for _ in range(100):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}
        items = [k for k, n in counts.items() for _ in range(n)]
        longest = max(items)
        items.remove(longest)
        sums = {longest}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 30}
        fill = packing.best_fill(30, counts)
        assert sum(k * n for k, n in fill.items()) == max(sums) and all(n <= counts[k] for k, n in fill.items())


def test_exact_duplicates(spark, docs, none):
    got = exact_dedup.exact_duplicates(docs, capacity=2).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    assert len(got) == len(ROWS)
    for r in got:
        g = groups[(ODD[r.doc_id] or "").encode().lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_directory_doubles():
    buckets = exact_dedup.directory({0: 5, 1: 5, 7: 1}, 5, 3)
    assert buckets == [(0, 3), (1, 3), (1, 2), (1, 1)]


def test_colliding_keys_chain_by_bytes():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"bucket": pa.array([0, 0, 0], pa.int32()), "key": [9, 9, 9], "norm": pa.array([b"a", b"b", b"a"]), "keep_id": [1, 2, 3], "group_size": [1, 1, 2]})
    rows = next(exact_dedup._owned(iter([b]))).to_pylist()
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in rows] == [(0, 3, 3), (1, 2, 1)]


def test_warc(spark, tmp_path):
    html = "<p>" + "x" * 200 + "\r\n\r\né</p>"
    pages = spark.createDataFrame([(3, "http://a/\r\nb", html), (1, None, html), (2, "http://c", "short"), (5, "http://d", "short"), (4, "http://e", None), (None, "http://f", html)], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_records(index, f"{tmp_path}/w").collect()}
    assert got[1].record_type == "response" and bytes(got[1].payload).decode() == html
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[3].payload_bytes == len(html.encode())
    assert got[2].record_type == got[5].record_type == got[None].record_type == "response" and got[4].payload_bytes == 0
    assert warc.write_archives(pages.limit(0), f"{tmp_path}/e").count() == 0


def test_permutation_is_one():
    import numpy as np

    for n in (1, 2, 3, 10, 1000):
        p = shards.permuted(np.arange(n), n, key=5)
        assert sorted(p) == list(range(n))
        assert (shards.permuted(p, n, key=5, backwards=True) == np.arange(n)).all()


def test_shards(spark, docs, none, tmp_path):
    t = tokens.load(WORD)
    docs.write.parquet(f"{tmp_path}/d")
    index = shards.write_shards(spark.read.parquet(f"{tmp_path}/d"), f"{tmp_path}/s", WORD, 2, length=32, slots=8)
    rows = shards.read_shards(index, f"{tmp_path}/s", 32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.shard == r.slot // 8 and r.record == r.slot % 8 for r in rows)
    n = 0
    for r in rows:
        ids = struct.unpack("<32H", r.ids)
        for s in r.spans:
            want = [*t.encode(ODD[s.doc_id] or "", add_special_tokens=False).ids, 2]
            assert list(ids[s.offset : s.offset + s.length]) == want[s.start : s.start + s.length]
            n += s.length
    assert n == sum(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in ROWS)
    assert shards.write_shards(none, f"{tmp_path}/e", WORD, 2).count() == 0


def test_sketch(spark, docs, none):
    h = sketch.Hasher()
    a, b = sketch.bottom(h(BASE)), sketch.bottom(h(BASE.replace(VOCAB[3], "zz")))
    assert sketch.resemblance(a, a) == 1 and 0.2 < sketch.resemblance(a, b) < 1 and sketch.resemblance(a, sketch.bottom(h(""))) == 0
    assert (sketch.of_text(sketch.text_of(a)) == a).all() and sketch.containment(a, sketch.bottom(h(BASE + " end"))) == 1
    big = sketch.bottom(h(" ".join(str(i) for i in range(20000))))
    assert abs(sketch.distinct(big) / 19996 - 1) < 0.3
    got = sketch.fingerprints(docs).collect()
    assert len(got) == len(ROWS) and {len(r.sketch) for r in got if r.doc_id in (0, 1, 2)} == {0}
    part = sketch.fingerprints(docs.where("doc_id in (10, 14)")).withColumn("k", F.lit(1))
    assert sketch.merged(part, ["k"]).first().sketch == [int(x) for x in sketch.merge(a, sketch.bottom(h(BASE + " end")))]
    assert sketch.fingerprints(none).count() == 0


def test_successors(spark, docs):
    rows = sketch.with_successors(docs.dropDuplicates(["doc_id"]), 4).collect()
    nexts = {}
    for x, y in zip(rows, rows[1:], strict=False):
        if x.bucket == y.bucket:
            nexts[x.doc_id] = y.doc_id
    n = len(ODD)
    assert nexts == {i: (i - 1) % n for i in range(n)}


def test_language(spark):
    rnd, rows = random.Random(2), []
    words = {"aa": ["fox", "dog", "house", "river"], "bb": ["zug", "haus", "fluss", "katze"]}
    for i in range(60):
        k = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rnd.choice(words[k]) for _ in range(12)), k))
    model = langid.fit(spark.createDataFrame([*rows, (99, None, "aa"), (98, "x y", None)], "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "fox river house", 1.0), (2, "flussig katzen", 0.0), (3, None, 0.0), (4, "12 !?", 0.0), (5, "", 0.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in langid.predict(test, model).collect()}
    assert got[1].lang_pred == "aa" and got[2].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got.values())
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und"
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.predict(test, empty).where("lang_pred <> 'und'").count() == 0


def test_rare_language_is_learned(spark):
    rows = [(i, "fox dog house river", "aa") for i in range(3000)] + [(5000 + i, "zug haus fluss katze", "bb") for i in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=20)
    assert model.langs == ["aa", "bb"] and model.words["katze"] != model.words["fox"]
    test = spark.createDataFrame([(1, "katze fluss")], "doc_id long, text string")
    assert langid.predict(test, model).first().lang_pred == "bb"


def plain_components(rows, words=3, share=90):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_ngram_join(spark, docs, none):
    rnd, rows = random.Random(11), [(i, t) for i, t, *_ in ROWS[:-1]]
    for i in range(100, 220):
        w = BASE.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        rows.append((i, " ".join(w[: rnd.choice([9, 40, 120])])))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), part=20).collect()
    want = plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.jaccard_components(spark.createDataFrame([(None, BASE), (1, BASE)], "doc_id long, text string")).where("doc_id is null and component_id is null").count() == 1


def test_ngram_join_with_common_passages(spark):
    """A passage that all texts share connects none of them, and no link between near copies is lost."""
    rnd = random.Random(5)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = words(40)
    texts = []
    for i in range(300):
        own = words(rnd.randint(100, 260))
        at = rnd.randrange(len(own))
        texts.append(own[:at] + passage + own[at:])
        for _ in range(i % 3 if i % 10 == 0 else 0):  # copies with a few words changed, linked or nearly so
            near = list(texts[-1])
            for k in rnd.sample(range(len(near)), rnd.randint(1, 6)):
                near[k] = f"v{rnd.randrange(10**6)}"
            texts.append(near)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    top = lambda x: x if root[x] == x else top(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, words=5, share=80).collect()}
    assert got == {i: top(i) for i in range(len(texts))} and len(set(got.values())) < len(texts)
    described = df.select("doc_id", F.col("text").cast("binary")).mapInArrow(partial(ngram_join._described, words=5, share=80), "doc_id long, n_shingles long, set_key string, segments array<long>, spared array<int>")
    near = ngram_join._near(described.select("set_key", "segments", "spared")).collect()
    assert len({x for r in near for x in r}) < len(texts) / 2


def test_near_duplicates_stage(spark):
    import corpus_pipeline

    rnd, rows = random.Random(12), []
    for i in range(60):
        w = [rnd.choice(VOCAB) for _ in range(rnd.choice([12, 60, 150, 400]))]
        at, n = rnd.randrange(len(w)), rnd.choice([1, max(1, len(w) // 12)])
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:at] + [rnd.choice(VOCAB) for _ in range(n)] + w[at + n :]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (_, root) in plain_components(rows, 5, 80).items() if i == root}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want
    assert len(want) < sum(i == root for i, (_, root) in plain_components(rows).items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}


def test_lines(spark, none):
    long = " ".join(VOCAB[:60])
    near = long.replace(VOCAB[20], "changed")
    rows = [(1, f"{long}\n\nshort one", "x"), (2, f"  {long.upper()} \nown line of two", "x"), (3, near, "x"), (4, None, "x"), (5, "", "x"), (6, "short one", "x"), (6, "short one", "x")]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string")).collect() if r.text is not None)
    assert got == [(1, f"{long}\n\nshort one", 3, 0), (2, "own line of two", 2, 1), (3, "", 1, 1), (5, "", 1, 0), (6, "", 1, 1), (6, "", 1, 1)]
    assert line_dedup.dedup_lines(none).count() == 0


def plain_line_roots(lines):
    """Each distinct line's component as the set of its lines, by brute force."""
    sets = {x: {x[i : i + 5] for i in range(len(x) - 4)} if len(x) >= 5 else {x} for x in lines}
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(sets)
    for i, x in enumerate(names):
        for y in names[:i]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                up[root(x)] = root(y)
    return {x: root(x) for x in names}


def dropped_lines(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    return {r.doc_id for r in line_dedup.dedup_lines(df).where("n_dropped > 0").select("doc_id").collect()}


def plain_dropped(lines):
    roots, first, out = plain_line_roots(lines), set(), set()
    for i, x in enumerate(lines):
        if roots[x] in first:
            out.add(i)
        first.add(roots[x])
    return out


def test_lines_of_a_template(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))
    template, lines = words(28), []
    for _ in range(80):
        own = words(14)
        lines += [f"{template} {own}", f"{template} {own} {rnd.choice(VOCAB)}"]
    want = plain_dropped(lines)
    got = dropped_lines(spark, lines)
    assert len(want) >= 80 and got <= want and len(got) >= 0.97 * len(want)


def test_lines_of_all_lengths(spark):
    rnd, lines = random.Random(6), []
    for n in [*range(6, 240, 4), *[23] * 30, *[99] * 30]:
        text = ""
        while len(text) < n:
            text += ("" if not text else " ") + "".join(rnd.choice("abcdefghijklmnopqrstuvw") for _ in range(rnd.randint(2, 9)))
        line = text[: n - 1] + "x"
        lines += [line, line + "."]
    want = plain_dropped(lines)
    got = dropped_lines(spark, lines)
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)


def test_repetitive_lines(spark):
    lines = ["-" * 30, "-" * 80, "-" * 7, "ab cd efg hi " * 5 + "end", "ab cd efg hi " * 20 + "end", "one of its own"]
    assert dropped_lines(spark, lines) == plain_dropped(lines) == {1, 2, 4}


def test_lines_without_python(spark, monkeypatch):
    """Many near copies of one line, of which some are too far from its lead, by DataFrame functions alone."""
    rnd, lines = random.Random(8), []
    base = [rnd.choice(VOCAB) for _ in range(50)]
    for i in range(70):
        edits = set(rnd.sample(range(50), rnd.choice([1, 2, 4, 7])))
        lines.append(" ".join(f"{w}{i}" if j in edits else w for j, w in enumerate(base)))
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, lambda *a, **b: pytest.fail("runs Python"))
    want, got = plain_dropped(lines), dropped_lines(spark, lines)
    assert len(want) > 40 and got <= want and len(got) >= 0.95 * len(want)


def test_near_lines_meet_few_others(spark, monkeypatch):
    """Of many edited copies of one line, some of them too far from its lead, each meets a bounded number."""
    rnd, lines, made = random.Random(8), [], []
    base = [rnd.choice(VOCAB) for _ in range(50)]
    for i in range(300):
        edits = set(rnd.sample(range(50), rnd.choice([1, 2, 4, 7])))
        lines.append(" ".join(f"{w}{i}" if j in edits else w for j, w in enumerate(base)))
    pairs = line_dedup._pairs

    def counted(*args):
        made.append((out := pairs(*args)).count())
        return out

    monkeypatch.setattr(line_dedup, "_pairs", counted)
    want, got = plain_dropped(lines), dropped_lines(spark, lines)
    assert got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))
    assert max(made) <= 20 * len(lines), made


def test_every_open_pair_of_a_group_meets(spark):
    """Two similar lines of a group, both unlike its lead and unlike the line with most links, still meet."""
    n = lambda key, met, links: (5, key, 100, met, links)
    members = spark.createDataFrame([n(1, 1, 3), n(2, 1, 1), n(3, 3, 0), n(4, 4, 0), (5, 9, 300, 9, 0)], "band long, key long, n int, met long, links long")
    meet = lambda led: {(r.a, r.b) for r in line_dedup._pairs(members, 80, led).collect()}
    assert meet(True) == {(1, 3), (1, 4)}
    assert meet(False) == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_lines_that_share_a_passage(spark):
    """Pairs of near copies among many lines that have one long passage in common."""
    rnd, lines = random.Random(3), []
    words = lambda k: [rnd.choice(VOCAB) + str(rnd.randrange(50)) for _ in range(k)]
    passage = words(25)
    for _ in range(60):
        own = words(25)
        lines += [" ".join(own[:10] + passage + own[10:]), " ".join(own[:10] + passage + own[10:22] + words(3))]
    want, got = plain_dropped(lines), dropped_lines(spark, lines)
    assert len(want) == 60 and got <= want and len(got) >= 59


@pytest.mark.parametrize("wide", [1, 2, 20])
def test_blocks_in_parts(spark, wide):
    """A block of many parts: every similar pair is connected, whichever parts it lies in."""
    rnd, rows = random.Random(5), []
    for i in range(60):
        x = set(rnd.sample(range(40 * (i % 4), 40 * (i % 4) + 30), 26))
        rows.append((7, 0, 9, wide, i, np.array([len(x), *sorted(x)], np.uint64).tobytes()))
    df = spark.createDataFrame(rows, "block long, lead long, parts int, wide int, id long, payload binary")
    links = [(r.a, r.b) for r in blocks.block_links(df, 80, ngram_join.set_of, part=7).collect()]
    sets = {r[4]: set(ngram_join.set_of(r[5]).tolist()) for r in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert links
    assert joined(links, sets) == joined([(a, b) for a in sets for b in sets if a < b and alike(a, b)], sets)


def test_partial_overlaps_lose_nothing():
    rnd, sets = random.Random(6), []
    for i in range(90):
        base = [rnd.randrange(1 << 64) for _ in range(rnd.choice([1, 3, 30, 200]))] if i % 3 == 0 else base
        sets.append(np.unique(np.array([rnd.randrange(1 << 64) if rnd.random() < 0.07 else x for x in base], np.uint64)))
    low = [s[: np.searchsorted(s, np.uint64((1 << 62) - 1), "right")] for s in sets]
    totals, all_ = [len(s) for s in sets], np.ones((90, 90), bool)
    whole = set(blocks.overlaps(sets, None, all_, 80))
    assert whole == {(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert whole and whole <= set(blocks.overlaps(low, None, all_, 80, totals)) and len(blocks.overlaps(low, None, all_, 80, totals)) < 3 * len(whole) + 200
    cross = {(i, j - 40) for i, j in whole if i < 40 <= j}
    assert set(blocks.overlaps(sets[:40], sets[40:], all_[:40, :50], 80)) == cross <= set(blocks.overlaps(low[:40], low[40:], all_[:40, :50], 80, totals))
    assert all(((0, 1) in blocks.overlaps([low[i], low[j]], None, all_, 80, [totals[i], totals[j]])) for i, j in whole)


def joined(links, names):
    up = {x: x for x in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in names}


def test_bottoms():
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abcdé 😀") for _ in range(n)) for n in (1, 4, 5, 8, 9, 30, 96, 97, 400, 3000)] + ["-" * 500, "ab " * 300]
    for k in (5, 9):
        got, there = line_dedup.bottoms(lines, k)
        for x, row, ok in zip(lines, got, there, strict=True):
            want = np.unique(line_dedup.windows(line_dedup.codes_of(x), k))[:5].tolist() if len(x) >= k else []
            assert row[ok].tolist() == want


P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(t):
    out = []
    for k, (kind, p) in enumerate(P.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted(out))


def test_pii(spark, none):
    texts = ["é🙂 a.b@c.de_x@y.org, a@b@c.com", "1.2.3.4.5 300.1.1.1 0001.02.3.255 12.34.56.78.90.1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 x4111111111111111y", "+1 (499) 555-6503 +12 +1 234", "mail bob (at) site (dot) com call (415) 555-2671", None, "", "9" * 3000, "a" * 50_000 + "@", "+1 (499) 555-6503"]
    rnd = random.Random(5)
    texts += ["".join(rnd.choice("ab@.+- 0123456789()%_é") for _ in range(400)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = pii.annotate(df, pii.fit(df)).select("doc_id", "text", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s"), pii.masked(F.col("text"), F.col("spans")).alias("m"))
    for r in done.collect():
        assert r.b == plain_base(r.text), r.text
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
        if r.doc_id == 9:
            assert r.m == "[PHONE]"
    assert pii.annotate(none, pii.fit(none)).count() == 0


def test_failed_checks_are_not_outvoted(spark):
    """Numbers in the form of cards that fail their checksum, with no cue before them, among many that pass."""
    rnd = random.Random(8)

    def number(good):
        while True:
            d = "4" + "".join(str(rnd.randrange(10)) for _ in range(15))
            if (sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0) == good:
                return d

    texts = [f"the card {number(True)} was used for it" for _ in range(300)] + [f"some words {number(False)} and more words" for _ in range(40)] + [f"order number {number(False)} arrived" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.annotate(df, pii.fit(df)).select("doc_id", F.size("spans").alias("n")).collect():
        assert r.n == (r.doc_id < 300), texts[r.doc_id]
    # What is taken in spite of its checks has a cue before it and a posterior of OUTWEIGHS.
    assert not pii.takes("c-+0++13", 0.9999) and not pii.takes("c-++++13", pii.OUTWEIGHS - 0.01) and pii.takes("c-++++13", pii.OUTWEIGHS)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    text = lambda: "\n".join(" ".join(rnd.choice(VOCAB) for _ in range(30)) for _ in range(3))
    a, rows = text(), []
    for i in range(40):
        rows.append((i, text(), "en", "s", 1))
    rows += [(100, a, "en", "s", 1), (101, a, "en", "s", 1), (102, "123 !!", "en", "s", 1), (103, text() + "\nmail me@x.org now", None, "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert ids == {*range(40), 100, 103}


def test_lines_recall(spark):
    """Pairs of one edit or several, on all lengths, with and without spaces: at least 0.95 of the drops, no wrong ones."""
    rnd, lines = random.Random(8), []
    letters = "abcdefghijklmnopqrstuvw"
    text = lambda n, spaced: "".join(rnd.choice(letters + ("    " if spaced else "")) for _ in range(n)).strip() or "a"
    for i in range(600):
        a = text(rnd.choice([8, 10, 13, 17, 22, 30, 45, 63, 64, 65, 66, 90, 99, 101, 150, 199, 203, 400]), i % 4)
        n, at = max(1, len(a) // rnd.choice([12, 20, 60])), rnd.randrange(len(a))
        b = [a + text(n, i % 4), text(n, i % 4) + a, a[:at] + a[at + n :], a[:at] + "Z" + a[at + 1 :], a[:at] + text(n, True) + a[at:]][i % 5]
        lines += [a, b]
    lines = [x.strip(" ").lower() for x in lines if x.strip()]
    want, got = plain_dropped(lines), dropped_lines(spark, lines)
    assert len(want) > 300 and got <= want and len(got) >= 0.95 * len(want), (len(got), len(want))
