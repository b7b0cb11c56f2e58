"""Exact deduplication over an extendible-hash index on shared files.

A text's key is the 64-bit hash of its normalised bytes. The directory starts with one bucket and doubles wherever a
bucket holds more keys than its capacity, until none is overfull or the directory has its greatest depth. Each input task
folds equal texts before the shuffle, so that a text which a third of all rows share arrives once from each task. The
owner task of a bucket chains the texts of one key, compares their bytes and writes the bucket's entries to the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keep, small_batches, utf8

DEPTH = 16  # of the directory at most: 65,536 entries
KEYED = "doc_id long, key long, text_sha256 string"
FOLDED = "bucket int, key long, norm binary, keep_id long, group_size long"
ENTRY = "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long"


def normalised(text: bytes) -> bytes:
    """Lower-cases A-Z only: bytes.lower() leaves all other bytes alone."""
    return text.lower()


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norms = [normalised(x) for x in b.column(1).to_pylist()]
        keys = [_signed(xxhash.xxh3_64_intdigest(x)) for x in norms]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in norms])], ["doc_id", "key", "text_sha256"])


def directory(counts: dict[int, int], capacity: int, depth: int = DEPTH) -> list[tuple[int, int]]:
    """Buckets as (prefix, local depth), in order, from the number of keys by prefix of `depth` bits.

    A bucket over its capacity splits in two by the next bit; one whose keys differ only below `depth` stays and chains."""
    out, todo = [], [(0, 0)]
    ends = np.zeros((1 << depth) + 1, np.int64)
    for p, n in counts.items():
        ends[p + 1] = n
    ends = ends.cumsum()
    while todo:
        prefix, local = todo.pop()
        lo, hi = prefix << (depth - local), (prefix + 1) << (depth - local)
        if ends[hi] - ends[lo] > capacity and local < depth:
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            out.append((prefix, local))
    return out


def _folder(owner: np.ndarray, depth: int, most: int):
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys = [xxhash.xxh3_64_intdigest(x) for x in seen]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(owner[k >> (64 - depth)]) for k in keys], pa.int32()), pa.array(map(_signed, keys), pa.int64()), pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
                ["bucket", "key", "norm", "keep_id", "group_size"],
            )

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                norm = normalised(text)
                if (v := seen.get(norm)) is None:
                    seen[norm] = [doc, 1]
                    held += len(norm) + 200
                else:
                    v[0] = doc if v[0] is None or (doc is not None and doc > v[0]) else v[0]
                    v[1] += 1
            if held > most:
                yield out()
                seen, held = {}, 0
        if seen:
            yield out()

    return folded


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and key: one key's texts form a chain, told apart by their bytes."""
    at, chain, rows = None, [], []

    def close() -> None:
        rows.extend((*at, i, hashlib.sha256(norm).hexdigest(), best, n) for i, (norm, best, n) in enumerate(chain))

    def out() -> pa.RecordBatch:
        a = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"])

    for b in batches:
        for bucket, key, norm, best, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (bucket, key) != at:
                if at is not None:
                    close()
                at, chain = (bucket, key), []
            for link in chain:
                if link[0] == norm:
                    link[1] = best if link[1] is None or (best is not None and best > link[1]) else link[1]
                    link[2] += n
                    break
            else:
                chain.append([norm, best, n])
        if len(rows) > 10_000:
            yield out()
            rows = []
    if at is not None:
        close()
    if rows:
        yield out()


def build_index(docs: DataFrame, keyed: DataFrame, capacity: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The directory (prefix, bucket) and the index (bucket, key, chain, text_sha256, keep_id, group_size), both tables in the
    shared folder.

    capacity: keys in a bucket before it splits. It rises with the data so that the directory keeps at most about 2^14
    buckets; only its counts, 65,536 rows at most, reach the driver."""
    counts = {r[0]: r[1] for r in keyed.groupBy(_prefix().alias("p")).agg(F.count("*").alias("n")).collect()}
    buckets = directory(counts, max(min(capacity, sum(counts.values()) // 512 + 1), sum(counts.values()) >> 14))
    owner = np.empty(1 << DEPTH, np.int32)
    for i, (p, local) in enumerate(buckets):
        owner[p << (DEPTH - local) : (p + 1) << (DEPTH - local)] = i
    entries = keep(docs.sparkSession.createDataFrame(list(enumerate(owner.tolist())), "prefix int, bucket int").coalesce(1), "hash-directory")
    folded = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_folder(owner, DEPTH, 32 << 20), FOLDED)
    return entries, keep(folded.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_owned, ENTRY), "hash-index")


def _prefix() -> Column:
    """The directory's entry for a key: its first DEPTH bits."""
    return F.shiftrightunsigned("key", 64 - DEPTH).cast("int")


def exact_duplicates(docs: DataFrame, capacity: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text; other columns are ignored).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays; of repeated rows with that doc_id all are kept rows of the same id. A null doc_id is below all
    others. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed = keep(docs.select("doc_id", utf8("text").alias("text")).mapInArrow(_keyed, KEYED), "keys")
    entries, index = build_index(docs, keyed, capacity)
    groups = few(index.where("group_size > 1").select("bucket", "key", "text_sha256", "keep_id", "group_size"), F.lit(140))
    found = keyed.withColumn("prefix", _prefix()).join(F.broadcast(entries), "prefix")  # 65,536 entries, however large the input
    # Groups are sent if they are few; else a hot key is split by the optimizer: neither side is aggregated after this join.
    joined = found.join(groups, ["bucket", "key", "text_sha256"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
