"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 63-bit hashes of a text's shingles. Sketches of parts merge into the sketch of the
whole; two sketches estimate resemblance and containment, one estimates the number of distinct shingles. Below k shingles
all of these are exact but for hash collisions.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches

K, WORDS = 128, 5
#: Odd multipliers that tell a shingle's positions apart; the constants of a well-known 64-bit mixer.
_PLACE = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, np.uint64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Hasher:
    """Shingle hashes of texts; keeps the hashes of words it has met, up to a bound."""

    def __init__(self, words: int = WORDS, kept: int = 500_000):
        self.words, self.kept, self.known = words, kept, {}

    def __call__(self, text: str) -> np.ndarray:
        """Hashes of all shingles in order; a text with fewer words is one shingle, one without words has none."""
        parts, known = text.split(), self.known
        if not parts:
            return np.empty(0, np.uint64)
        try:
            w = np.array(list(map(known.__getitem__, parts)), np.uint64)
        except KeyError:
            if len(known) > self.kept:
                known.clear()
            for x in set(parts):
                if x not in known:
                    known[x] = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
            w = np.array(list(map(known.__getitem__, parts)), np.uint64)
        if len(w) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(w.tobytes()) >> 1], np.uint64)
        n = len(w) - self.words + 1
        h = w[:n].copy()
        for i in range(1, self.words):
            h += w[i : i + n] * _PLACE[i]
        h = (h ^ h >> np.uint64(30)) * _MIX[0]
        h = (h ^ h >> np.uint64(27)) * _MIX[1]
        return (h ^ h >> np.uint64(31)) >> np.uint64(1)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, sorted."""
    while len(hashes) > 16 * k:
        small = np.unique(np.partition(hashes, 8 * k)[: 8 * k])
        if len(small) >= k:
            return small[:k]
        hashes = np.unique(hashes)
        break
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """The number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (int(a[k - 1]) / 2.0**63)


def compared(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[float, float]:
    """Resemblance, the share of the union that both have, and containment, the share of a's shingles that b has too. Two
    texts without words are alike, one without words is unlike any other and contained in all."""
    if not len(a) or not len(b):
        return float(len(a) == len(b)), float(not len(a))
    union = merge(a, b, k)
    alike = float(np.isin(union, a, assume_unique=True).astype(int) @ np.isin(union, b, assume_unique=True)) / len(union)
    return alike, min(1.0, alike * distinct(union, k) / distinct(a, k))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    return compared(a, b, k)[0]


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    return compared(a, b, k)[1]


def text_of(sketch: np.ndarray) -> str:
    """A sketch as text: base64 of its big-endian 64-bit hashes."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def of_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def _sketches(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bottom(hasher(x or ""), k).astype(np.int64) for x in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "sketch"])

    return run


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id and sketch (array<long>) of each whole text of docs (doc_id, text). A null text counts as empty, an empty
    text has an empty sketch. Repeated rows stay; other columns are ignored."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketches(k, words), "doc_id long, sketch array<long>")


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts. Parts are cut to k hashes before they meet, so a key with a
    third of all rows sends at most k hashes from each task."""
    one = sketches.select(*keys, F.explode("sketch").alias("_h")).distinct()
    best = one.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("sketch"))


def _pairs(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, extra, doc_id, text) come in order; each but the bucket's last, the extra one, meets its successor."""
        hasher, last, rows = Hasher(words), None, []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next", "n_shingles"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 5)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            for bucket, doc, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = bottom(hasher(text), k)
                if last is not None and last[0] == bucket:
                    _, old, before, sketch = last
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    s = bottom(hasher(edited), k)
                    (near_edited, in_edited), (near_next, in_next) = compared(sketch, s, k), compared(sketch, own, k)
                    rows.append((old, len(before), hashlib.sha256(edited.encode()).hexdigest(), text_of(sketch), text_of(s), near_edited, near_next, in_edited, in_next, distinct(sketch, k)))
                last = (bucket, doc, text, own)
            if len(rows) >= 500:
                yield out()
                rows = []
        if rows:
            yield out()

    return run


def with_successors(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, extra, doc_id, text), dealt by bucket and sorted by descending doc_id (then text), each bucket followed
    by the first row of the next one (after the last: of the first) as an extra row.

    Buckets are ranges of doc_id by its quantiles; only each bucket's largest id reaches the driver. A null id comes last
    and stays null; rows of one id are in one bucket. A null text counts as empty."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf")))
    at = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    placed = docs.withColumn("_id", place)
    splits = [-float("inf"), *sorted(set(at)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_id", outputCol="_bucket").transform(placed) if at else placed.withColumn("_bucket", F.lit(0.0))
    dealt = cut.select((-F.col("_bucket")).cast("int").alias("bucket"), F.lit(0).alias("extra"), "doc_id", "text")
    heads = sorted((r[0], r[1]) for r in dealt.groupBy("bucket").agg(F.max("doc_id")).collect())  # nulls alone have none
    if heads:
        follows = spark.createDataFrame([(h[1], heads[i - 1][0]) for i, h in enumerate(heads)], "_head long, bucket int")
        first = docs.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("_head"))).groupBy("doc_id", "bucket").agg(F.min("text").alias("text"))
        dealt = dealt.unionByName(first.select("bucket", F.lit(1).alias("extra"), "doc_id", "text"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "text")


def neighbours(docs: DataFrame, buckets: int, k: int = K, words: int = WORDS) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its text with the last half replaced by as much of the
    next document's (descending doc_id, ties by text, nulls last; after the last: the first), likeness to and containment
    in both, and the estimated number of its distinct shingles.

    A null text counts as empty; repeated rows are documents of their own; an empty table gives an empty result; other
    columns are ignored."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double, n_shingles double"
    return with_successors(docs, buckets).mapInArrow(_pairs(k, words), schema)


def op6_fingerprints(spark, sf_dir):
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8 * shuffle_width(spark))
