"""SimHash components, whitening and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest
import xxhash

from siftline.llm import simhash, spelling, whitening

RND = random.Random(5)
VOCAB = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(200)]
BASE = [RND.choice(VOCAB) for _ in range(400)]


def near(words, k):
    w = list(words)
    for _ in range(k):
        w[RND.randrange(len(w))] = RND.choice(VOCAB)
    return " ".join(w)


TEXTS = [None, "", "  \n", "one", "One", "two words", "a b c", "A B  c\t", "é ß x y z", "long " * 3000] + [near(BASE, k) for k in (0, 0, 1, 2, 2, 3, 3, 5, 8, 15)] + [" ".join(RND.choice(VOCAB) for _ in range(RND.choice([1, 3, 8, 60]))) for _ in range(60)]
ROWS = [(i, t, "x", 0.5) for i, t in enumerate(TEXTS)] + [(12, TEXTS[12], "x", 0.5), (5, "other text of the id", "x", 0.5), (None, TEXTS[11], "x", 0.5), (None, "nothing like it at all", "x", 0.5)]
SCHEMA = "doc_id long, text string, fp string, component_id double"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(values, distance=3):
    """Component numbers of a list of fingerprints, by all pairs."""
    up = list(range(len(values)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_fingerprints_and_components(spark):
    got = simhash.simhash_components(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert len(got) == len(ROWS)
    prints = [plain_fingerprint(t) for _, t, *_ in ROWS]
    top = roots(prints)
    least = {}
    for r, (i, *_) in zip(top, ROWS, strict=True):
        least[r] = min(least.get(r, 1 << 40), 1 << 40 if i is None else i)
    want = sorted((-1 if i is None else i, f"{p:016x}", -1 if least[r] == 1 << 40 else least[r]) for (i, *_), p, r in zip(ROWS, prints, top, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(RND.choice(VOCAB) for _ in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def flipped(x, k):
    for b in RND.sample(range(64), k):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("m", [2, 3, 4, 5, None])
def test_links_of_any_deal(spark, m):
    """Dense balls, chains, a part's value that a third of all fingerprints share without links, and random ones, with values cut
    into many parts."""
    center, other = RND.getrandbits(64), RND.getrandbits(64)
    prints = {flipped(center, RND.randint(0, 4)) for _ in range(150)} | {RND.getrandbits(64) for _ in range(150)} | {(other & 0xFFFFFFFF) | RND.getrandbits(32) << 32 for _ in range(150)} | {0}
    x = RND.getrandbits(64)
    for _ in range(20):
        prints.add(x := flipped(x, 3))
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long").repartition(3)
    links = simhash.fingerprint_links(frame, most=23, m=m).collect()
    index = {p: i for i, p in enumerate(prints)}
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in links:
        a, b = sorted((top(index[r.a % (1 << 64)]), top(index[r.b % (1 << 64)])))
        up[b] = a
    assert [top(i) for i in range(len(prints))] == roots(prints)


def test_thresholds_add_up_and_avoid_common_values():
    parts = [list(range(k, k + 16)) for k in range(0, 64, 16)]
    fp = np.array([RND.getrandbits(64) << 16 & (1 << 64) - 1 for _ in range(50)], np.uint64)  # the first part is zero in all
    t = simhash.thresholds(fp, parts, [(np.array([0], np.uint64), np.array([1e7]))] + [(np.empty(0, np.uint64), np.empty(0))] * 3, [1.0] * 4, 3)
    assert (t.sum(1) == 0).all() and (t[:, 0] == -1).all()


VECTORS = [(i, [float(RND.gauss(0, 1) + 3), RND.gauss(0, 2), RND.gauss(-1, 0.3), RND.gauss(0, 1), RND.gauss(0, 0.1)]) for i in range(60)]
VECTORS += [(3, VECTORS[3][1]), (70, VECTORS[9][1]), (None, VECTORS[5][1]), (71, None), (72, [1.0, None, 0.0, 0.0, 0.0]), (73, [1.0, float("nan"), 0.0, 0.0, 0.0]), (74, [float("inf")] + [0.0] * 4), (75, []), (76, [1.0, 2.0]), (77, [-0.0] * 5)]
EMB = "vec_id long, embedding array<float>, n string, x int"


def test_whitening(spark):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in VECTORS], EMB).repartition(4)
    got = whitening.whiten(df).collect()
    rows = [(r.vec_id, [float(np.float32(c)) for c in r.embedding]) for r in df.collect() if r.embedding is not None and len(r.embedding) == 5 and all(c is not None and np.isfinite(c) for c in r.embedding)]
    xs = [(i, tuple(floor(256 * Fraction(c)) for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, S = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    V = np.array([[float(sum(Fraction(n * x[i] - S[i], n) * Fraction(n * x[j] - S[j], n) for x in fit) / n) for j in range(5)] for i in range(5)])
    values, vectors = np.linalg.eigh(V)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(xs)
    by = {}
    for r in got:
        by.setdefault((r.component, r.vec_id), []).append(r)
    for k in range(4):
        sign = 0
        for i, x in xs:
            want = float(np.dot([float(Fraction(n * c - s, n)) for c, s in zip(x, S, strict=True)], vectors[:, k]) / np.sqrt(values[k]))
            r = by[k + 1, i][0]
            sign = sign or (1 if want * r.whitened > 0 else -1)
            assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, S, strict=True))
            assert r.whitened == pytest.approx(sign * want, abs=1e-8) and r.explained == pytest.approx(values[k] / np.trace(V), rel=1e-9) and r.identity_error < 1e-9


def test_scatter_is_exact_for_large_entries():
    x = np.array([[RND.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(40)] + [[0, -1, 1 << 60]], np.int64)
    total, cross = whitening.scatter(x)
    rows = x.tolist()
    assert total.tolist() == [sum(r[i] for r in rows) for i in range(3)]
    assert cross.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def test_whitening_of_large_numbers_and_without_variance(spark):
    big = [(i, [float(RND.randrange(1 << 40)), float(i % 3 << 38)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 18 and all(r.deviation is None or r.deviation >= 0 for r in got) and {r.n for r in got} == {9}
    for one in ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(one, "vec_id long, embedding array<double>")).collect() == []


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_spelling(spark):
    base = ["garden", "gardens", "aaaaaa", "aaaaa", "aaaaaaa", "ababab", "ababa", "straße", "Ärger", "ärger", "naïve", "x×yzw", "window", "widnow", "wimdow", "windows", "short", "four"]
    pool = base + ["".join(RND.choice("abc") for _ in range(RND.randint(5, 8))) for _ in range(150)]
    weights = [RND.choice([1, 1, 2, 9, 40]) for _ in pool]
    sep = [" ", ", ", "\n", "1", "中", "_", "Ā"]
    texts = ["".join((w.upper() if RND.random() < 0.1 else w) + RND.choice(sep) for w in RND.choices(pool, weights, k=RND.choice([1, 40, 300]))) for _ in range(80)]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1.0), (None, texts[5], "x", 1.0), (90, None, "x", 1.0), (91, "", "x", 1.0), (92, "中文", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n double").repartition(3)
    got = {tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_variants(rows)
    assert got == want and sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] and x[1] for x in want)


def test_pieces_end_between_runs(monkeypatch):
    text = " ".join(RND.choice(VOCAB) for _ in range(400)) + "x" * 100
    whole = b"".join(spelling.pieces(text)).split()
    monkeypatch.setattr(spelling, "PIECE", 16)
    assert [run for p in spelling.pieces(text) for run in p.split()] == whole == text.encode().split()
