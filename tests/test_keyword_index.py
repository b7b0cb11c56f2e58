"""Cover density against a plain model and hand examples; the index's layout."""

import random
import re

import numpy as np
import pytest

from siftline.functions import text as X
from siftline.operators import keyword_index as N

RND = random.Random(3)
WORDS = ["house", "houses", "the", "and", "garden", "gardens", "running", "stone", "river", "und", "häuser", "licht"] + [f"w{i}" for i in range(30)]


def hits(pairs, n):
    """covers() of (position, group) pairs."""
    at = sorted({p for p, _ in pairs})
    bits = [sum(1 << g for g in {g for q, g in pairs if q == p}) for p in at]
    return N.covers(np.array(at), np.array(bits), (1 << n) - 1)


@pytest.mark.parametrize(("pairs", "n", "want"), [
    ([(1, 0), (2, 0)], 1, 0.2),  # either word, side by side
    ([(1, 0), (2, 1)], 2, 0.1),  # both words, side by side
    ([(1, 0), (3, 1)], 2, 0.05),  # one word between
    ([(1, 0), (11, 1)], 2, 0.01),
    ([(1, 0)], 2, 0.0),
    ([(1, 0), (2, 1), (3, 0)], 2, 0.2),  # two covers that share a word
    ([(1, 0), (2, 0), (5, 1)], 2, 0.1 / 3),  # the shortest stretch alone
    ([(4, 0), (4, 1)], 2, 0.1),  # one position for both
])
def test_hand_examples(pairs, n, want):
    assert hits(pairs, n) == pytest.approx(want)


def plain_covers(pairs, n):
    """All minimal stretches, by trying each."""
    at = sorted({p for p, _ in pairs})
    full = [(a, b) for a in at for b in at if a <= b and {g for p, g in pairs if a <= p <= b} == set(range(n))]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in at) - 1)) for a, b in least)


def test_random_covers():
    for _ in range(300):
        n = RND.randint(1, 4)
        pairs = [(RND.randint(1, 25), RND.randrange(n)) for _ in range(RND.randint(0, 14))]
        assert hits(pairs, n) == pytest.approx(plain_covers(pairs, n))


ENDINGS = {c: re.compile(p) for c, p in X.ENDINGS.items()}
CONFIG = {"DE": "german", "FR": "french", "IT": "italian", "ES": "spanish"}


def stem(w, c):
    return ENDINGS[c].sub(lambda m: m[1], w)


def tokens(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def lexeme_positions(title, content, context, language):
    w = tokens(" ".join([title or "", content or "", context or ""]))
    c = CONFIG.get(language, "english")
    out = {}
    for i, x in enumerate(w, 1):
        out.setdefault(x, set()).add(i)
    for i, x in enumerate(w, 1):
        if x not in X.STOPWORDS[c]:
            out.setdefault(stem(x, c), set()).add(i + len(w))
    return out


def forms(w):
    return {w} | {stem(w, c) for c in ENDINGS if w not in X.STOPWORDS[c]}


@pytest.fixture(scope="module")
def data(spark):
    text = lambda n: " ".join(RND.choice(WORDS) for _ in range(n))
    chunks = [(i, RND.choice(["title", None, "the garden"]), text(RND.choice([0, 5, 30, 90])), RND.choice([None, "stone river"]), RND.choice(["EN", "DE", "FR", None])) for i in range(60)] + [(60, None, None, None, None), (None, "x", "house", None, "EN")]
    queries = [(i, text(RND.choice([1, 2, 3, 6]))) for i in range(25)] + [(90, ""), (91, None), (92, "the of"), (None, "house")]
    return spark.createDataFrame(chunks, "chunk_id long, title string, content string, context string, language string").repartition(3), spark.createDataFrame(queries, "query_id long, text string"), chunks, queries


@pytest.mark.parametrize("every", [False, True])
def test_ranks_equal_a_plain_model(spark, data, tmp_path, every, monkeypatch):
    monkeypatch.setattr(N, "QUERIES", 7)
    monkeypatch.setattr(N, "BY_NAME", 3 if every else 1000)
    chunks, queries, plain_chunks, plain_queries = data
    N.build(chunks, str(tmp_path / "index"), shards=3)
    entries = N.opened(spark, str(tmp_path / "index"))
    got = N.cover_topk((N.all_of if every else N.any_of)(queries), entries, 5).collect()
    want = {}
    for q, t in plain_queries:
        words = list(dict.fromkeys(w for w in tokens(t) if len(w) >= 3)) if every else tokens(t)
        groups = [{f for f in forms(w) if len(f) >= 3} for w in words] if every else [{f for w in words for f in forms(w) if len(f) >= 3}]
        if q is None or not any(groups):
            continue
        ranks = []
        for c, *body in plain_chunks:
            if c is not None:
                at = lexeme_positions(*body)
                pairs = [(p, g) for g, own in enumerate(groups) for f in own for p in at.get(f, ())]
                if r := round(plain_covers(pairs, len(groups)), 6):
                    ranks.append((-r, c))
        want |= {(q, o): (c, -r) for o, (r, c) in enumerate(sorted(ranks)[:5], 1)}
    assert {(r.query_id, r.ord): (r.chunk_id, r.rank) for r in got} == want and want


def test_index_has_sorted_positions_and_limits(spark):
    text = "stop " * 400 + "x " * 20_000 + "tail"
    rows = N.postings(spark.createDataFrame([(1, None, text, None, "EN")], "chunk_id long, title string, content string, context string, language string")).collect()
    at = {r.lexeme: r.positions for r in rows}
    assert all(p == sorted(set(p)) for p in at.values()) and len(at["stop"]) == N.IN_ALL and at["stop"][:255] == list(range(1, 256))
    assert at["tail"] == [N.LAST]


def test_scan_skips_by_lexeme(spark, data, tmp_path):
    N.build(data[0], str(tmp_path / "index"), shards=2)
    q = spark.createDataFrame([(1, "garden")], "query_id long, text string")
    plan = N.cover_topk(N.any_of(q), N.opened(spark, str(tmp_path / "index")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "In(lexeme" in plan or "EqualTo(lexeme" in plan
