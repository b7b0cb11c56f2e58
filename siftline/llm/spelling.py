"""Spelling variants: words one edit apart, found by a prefix filter over their rarest positional bigrams.

An edit touches at most two bigrams of a word on either side, so two words that are one edit apart share a bigram among the
three first of each by one global order, at the same place or, behind the edit, one further in the longer word. The order
is by the bigram's frequency over all words, the rarest first. Pairs that meet so are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

LETTERS, LEAST, SPAN = 5, 3, 97  # code points and occurrences of a word at least; one run in SPAN loses a letter
PREFIX = 3
PIECE = 4 << 20  # characters of a text that are cut into runs at once
HELD = 200_000  # words that a task counts before it sends them on
#: Latin-1 bytes: A-Z in lower case, a-z and those from 0xC0 stay, all others part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def pieces(text: str) -> Iterator[bytes]:
    """A text's folded Latin-1 bytes in pieces that end between runs; characters beyond Latin-1 part words."""
    rest = b""
    for at in range(0, len(text), PIECE):
        folded = rest + text[at : at + PIECE].encode("latin-1", "replace").translate(FOLD)
        cut = folded.rfind(b" ") + 1 if at + PIECE < len(text) else len(folded)
        rest = folded[cut:]
        yield folded[:cut]


def misspelt(doc_id: int | None, run: bytes) -> bytes:
    """The run (folded, Latin-1), without one letter if SPAN divides the checksum of document and run."""
    name = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(name, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % SPAN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): a task's words of LETTERS code points or more."""
    words: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for piece in pieces(text):
                for run, n in Counter(piece.split()).items():
                    if len(run) >= LETTERS and len(w := misspelt(doc_id, run)) >= LETTERS:
                        words[w] += n
                if len(words) > HELD:
                    yield out()
                    words.clear()
    if words:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents (doc_id, text), by LETTERS and LEAST; one letter is deleted from some runs."""
    small_batches(docs.sparkSession)
    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(_counted, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _rare(batches: Iterator[pa.RecordBatch], rank: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(word, n, gram, at, size): the PREFIX first bigrams of each word by rank, then place."""
    for b in batches:
        rows = []
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))[:PREFIX]
            rows += [(word, n, g, i, len(word)) for g, i in grams]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["word", "n", "gram", "at", "size"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each two of words (word, n; of two letters or more) that are exactly one edit apart, once."""
    gram = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    counts = gram.groupBy("gram").agg(F.count("*").alias("n")).collect()  # bigrams of 90 letters: 8100 at most
    rank = {r.gram: i for i, r in enumerate(sorted(counts, key=lambda r: (r.n, r.gram)))}
    rare = keep(words.select("word", "n").mapInArrow(partial(_rare, rank=rank), "word string, n long, gram int, at int, size int"), "spelling-grams")
    # The edit is behind the common bigram or before it, and on its other side the words agree: with that side in the key, the
    # shorter word meets words of its length at the same place, and longer ones there or one further.
    key = lambda side, i, k: F.xxhash64(F.lit(side), F.col("gram"), F.col("at") + i, F.col("size") + k, F.substring("word", F.lit(1), F.col("at")) if side == "before" else F.substring("word", F.col("at") + 3, F.col("size")))
    own, longer = [key("before", 0, 0), key("behind", 0, 0)], [key("before", 0, 1), key("behind", 1, 1)]
    left = rare.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("size").alias("a_size"), F.explode(F.array(*own, *longer)).alias("key"))
    right = rare.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("size").alias("b_size"), F.explode(F.array(*own)).alias("key"))
    met = left.join(right, "key").where((F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where following forms ends. A form occurs twice as often as its word, so a chain is no
    longer than the logarithm of the counts, and each round doubles the step."""
    step = keep(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-steps")
    while not step.where("open").isEmpty():
        up = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(step.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-steps")
    return step.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of docs (doc_id, text; other columns are ignored).

    Words are the runs of letters (A to Z, and U+00C0 to U+00FF), A-Z in lower case, of which one letter is deleted where the
    checksum of document and run says so. A null text has none; a null doc_id counts as an empty one in the checksum; repeated
    rows count again. A form is the most frequent word one edit away (ties: the first in code-point order) if it occurs at
    least twice as often. An empty table gives an empty result."""
    words = keep(word_counts(docs), "spelling-words")
    pairs = keep(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(near, "word", "left").withColumn("good", F.coalesce(-F.col("best.m") >= 2 * F.col("n"), F.lit(False)))
    found = found.select("word", F.when(F.col("good"), F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), -F.col("best.m")).alias("form_n"))
    found = keep(found, "spelling-forms")
    root = followed(found.where("form is not null").select("word", "form"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir):
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
