"""Similarity join of documents by their n-gram sets: a blocked sparse matrix product with size-derived bounds.

The incidence matrix has a row for each distinct set of word shingles. Links need |x & y| / |x | y| >= t, which bounds both
the ratio of sizes and the number of shingles in only one of the two sets. So rows fall into blocks: within a range of
sizes the hash space is cut into one segment more than shingles may differ, and two linked sets agree in at least one
whole segment (the pigeonhole principle, so no link is lost). There are spare segments beside, for which each set leaves out
the segments that most sets have. Sets with a common segment form blocks. The product of a
block's rows with themselves accumulates overlap counts over ranges of columns; after each range, pairs that their columns
to come can't lift to the bound are discarded, and rows without a possible pair leave the later ranges.

Texts are read where they lie: the table of
blocks, counted, goes to the texts unless it is too large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import OF, PART, block_links, shape
from .common import few, keep, release, scratch, small_batches, utf8
from .files import forget
from .graph import components

SHARE, WORDS = 90, 3
ENTRIES = 1_000_000  # shingles of a part at most, unless one row has more
LOW = 4  # parts of the hash space, of which the lowest is multiplied first
_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Shingles:
    """Sorted distinct hashes of a text's shingles of three words, or as many as given, A-Z in lower case."""

    def __init__(self, words: int = WORDS, kept: int = 300_000):
        self.words, self.kept, self.known = words, kept, {}

    def __call__(self, text: bytes) -> np.ndarray:
        parts, known = text.lower().split(), self.known
        if not parts:
            return np.empty(0, np.uint64)
        try:
            w = np.array(list(map(known.__getitem__, parts)), np.uint64)
        except KeyError:
            if len(known) > self.kept:
                known.clear()
            known |= {x: xxhash.xxh3_64_intdigest(x) for x in set(parts) if x not in known}
            w = np.array(list(map(known.__getitem__, parts)), np.uint64)
        if len(w) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(w.tobytes(), seed=len(w))], np.uint64)
        n = len(w) - self.words + 1
        h = w[self.words - 1 :] * _A[2]
        for k in range(self.words - 2, -1, -1):
            h = _mix(w[k : n + k] * _A[min(k, 1)] + h)
        return np.unique(h)


@lru_cache(1 << 16)
def size_range(n: int, share: int = SHARE) -> tuple[int, tuple[int, int], tuple[int, int]]:
    """Of the range of sizes that n falls in: its number, and (segments, spare ones) for it as the smaller and as the larger side."""
    lo, i, before = 1, 0, (1, 0)
    while True:
        hi = max(lo, lo * OF // share)
        # Shingles in one set only: at most (1-t)/(1+t) of both sizes, the smaller one hi at most and the larger one hi/t.
        least = (OF - share) * (hi * share + hi * OF) // (share * (OF + share)) + 1
        spare = int(5 * least * math.exp(-lo / least)) if least > 1 else 0
        if n <= hi:
            return i, (least + spare, spare), before
        lo, i, before = hi + 1, i + 1, (least + spare, spare)


def families(s: np.ndarray, share: int = SHARE) -> list[tuple[np.ndarray, int]]:
    """Hashes of the segments of a set, for its own range of sizes and for the one below, each with how many of them, the most
    frequent ones of all sets, may be left out.

    Linked sets agree in one segment more than there are spare ones. So in any order of all segments a set may leave out its
    last ones, as many as are spare: the first that two linked sets have in common isn't among them. Empty segments come last."""
    i, own, below = size_range(len(s), share)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s + np.uint64(1)), dtype=np.uint64)])
    out = []
    for number, (m, spare) in ((i, own), (i - 1, below)):
        if number < 0:
            continue
        cuts = np.array([(j << 64) // m for j in range(1, m)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
        place = _mix(np.arange(m, dtype=np.uint64) + np.uint64(((number + 1) << 32) * 7 + 3))
        x, filled = _mix((sums[at[1:]] - sums[at[:-1]]) ^ place), at[1:] > at[:-1]
        empty = m - int(filled.sum())
        out.append((x[filled], spare - empty) if empty <= spare else (x, 0))
    return out


def signatures(s: np.ndarray, share: int = SHARE) -> np.ndarray:
    """The hashes of families."""
    return np.concatenate([x for x, _ in families(s, share)])


def _described(batches: Iterator[pa.RecordBatch], words: int, share: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingles(words)
    for b in batches:
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        signed = [families(s, share) if len(s) else None for s in sets]
        segments = [f and np.concatenate([x for x, _ in f]).view(np.int64) for f in signed]
        spared = [f and [n for x, spare in f for n in (len(x), spare)] for f in signed]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), pa.array(segments, pa.list_(pa.int64())), pa.array(spared, pa.list_(pa.int32()))],
            ["doc_id", "n_shingles", "set_key", "segments", "spared"],
        )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, key, family) from (set_key, segments, spared): a segment's hash with a set that has it, named by half its key; family:
    twice the number of segments that it may leave out there, plus one for the range of sizes below its own."""
    done: set[str] = set()
    for b in batches:
        offsets, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
        at, keys, families = [], [], []
        for i, (key, spared) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            if key in done:
                continue
            done.add(key)
            x = flat[offsets[i] : offsets[i + 1]]
            at.append(x)
            keys.append(np.full(len(x), half_key(key), np.int64))
            families += [np.full(n, 2 * spare + k, np.int32) for k, (n, spare) in enumerate(zip(spared[::2], spared[1::2], strict=True))]
        if len(done) > 100_000:
            done.clear()
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(families))], ["at", "key", "family"])


def half_key(key: str) -> int:
    x = int(key[:16], 16)
    return x - (1 << 64) if x >> 63 else x


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, key, family, n) from (at, key, family) sorted: the segments that n sets have, n above 1, a row for each of these."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(at: np.ndarray, key: np.ndarray, family: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])])
        at, key, family = at[new], key[new], family[new]  # copies of a set are one
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.repeat(size := np.diff(np.append(begins, len(at))), size)
        if (many := n > 1).any():
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (at, key, family, n.astype(np.int64))], ["at", "key", "family", "n"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = tuple(c.to_numpy() for c in b.columns)
        ends = np.searchsorted(rows[0], rows[0][-1])  # the last segment may go on
        if ends or held and rows[0][0] != held[-1][0][-1]:
            if whole := [*held, *([tuple(r[:ends] for r in rows)] if ends else [])]:
                yield from out(*(np.concatenate(x) for x in zip(*whole, strict=True)))
            held = []
        held.append(tuple(r[ends:] for r in rows))
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _shingled(batches: Iterator[pa.RecordBatch], words: int, low: int) -> Iterator[pa.RecordBatch]:
    """Payloads: how many shingles a set has, and their hashes (those in the lowest of `low` parts of the hash space)."""
    shingles, bound = Shingles(words), np.uint64((1 << 64) // low - 1)

    def payload(s: np.ndarray) -> bytes:
        return len(s).to_bytes(8, "little") + (s[: np.searchsorted(s, bound, "right")] if low > 1 else s).tobytes()

    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([payload(shingles(x)) for x in b.column("text").to_pylist()], pa.binary())], ["id", "payload"])


def _near(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that connect all sets with a common segment, each set without those of its segments that most sets
    have, as many as it may leave out: passages that many texts share would else connect them all."""
    spark = sets.sparkSession
    segments = sets.mapInArrow(_signed, "at long, key long, family int")
    common = keep(segments.repartition("at").sortWithinPartitions("at", "key").mapInArrow(_common, "at long, key long, family int, n long"), "common", path := scratch(spark, "common"))
    release(spark)
    last = Window.partitionBy("key", "family").orderBy(F.desc("n"), F.desc("at"))
    rows = common.withColumn("_i", F.row_number().over(last)).where(F.col("_i") > F.floor(F.col("family") / 2)).select("at", "key")
    leads = rows.withColumn("lead", F.min("key").over(Window.partitionBy("at")))
    near = keep(leads.where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct(), "near")
    forget(path)
    return near


def set_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint64, offset=8)


def total_of(payload: bytes) -> int:
    return int.from_bytes(payload[:8], "little")


def _block_links(docs: DataFrame, blocks: DataFrame, words: int, share: int, part: int, low: int = 1) -> DataFrame:
    """Pairs that connect the linked documents of each block; blocks: (rep, size, block). With low above 1, by the lowest of so
    many parts of the hash space: the pairs that may be linked."""
    shapes = blocks.groupBy("block").agg(F.min("rep").alias("lead"), F.count("*").alias("_n"), *shape(F.count("*"), F.sum("size") / low, part, ENTRIES)).where("_n > 1").drop("_n")
    blocks = keep(blocks.join(shapes, "block").select(F.col("rep").alias("id"), "block", "lead", "parts", "wide"), "rows")
    wanted = few(keep(blocks.select(F.col("id").alias("doc_id")).distinct(), "wanted"), F.lit(16))
    sets = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text").mapInArrow(partial(_shingled, words=words, low=low), "id long, payload binary")
    sets = keep(sets, "block-sets", at := scratch(docs.sparkSession, "block-sets"))
    work = sets.join(few(blocks, F.lit(48)), "id").select("block", "lead", "parts", "wide", "id", "payload")
    links = block_links(work, share, set_of, part, total_of if low > 1 else None)
    forget(at)
    release(docs.sparkSession)
    return links


def jaccard_components(docs: DataFrame, part: int = PART, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text): the smallest doc_id that links reach.

    Documents link when their sets of shingles (of `words` words) have a Jaccard similarity of share hundredths or more. A null text is empty;
    empty texts and those without words link with nothing. Repeated rows of one doc_id stay and have its component. A null
    doc_id links with nothing and has a null component. Other columns are ignored. part: rows of a block that are multiplied
    at once; more are cut into parts."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"))
    described = docs.mapInArrow(partial(_described, words=words, share=share), "doc_id long, n_shingles long, set_key string, segments array<long>, spared array<int>")
    described = keep(described, "sets", fat := scratch(docs.sparkSession, "sets"))
    own = described.where("set_key is not null and doc_id is not null")
    classes = keep(own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("size")), "classes")
    near = _near(own.select("set_key", "segments", "spared"))
    described = keep(described.drop("segments", "spared"), "set-keys")
    del own
    forget(fat)  # the segments and their shuffle are the largest data, and nothing needs them any more
    release(docs.sparkSession)
    root = components(near)
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    half = F.conv(F.substring("set_key", 1, 16), 16, -10).cast("long")
    rows = keep(classes.withColumn("node", half).join(nodes, "node").select("rep", "root", "size"), "blocks")
    # Linked sets are of one class of sizes or of neighbouring ones, so each class meets the one below it.
    step = F.floor(F.log(F.col("size")) / math.log(OF / share)).cast("int")
    first = rows.withColumn("step", F.explode(F.array(step, step + 1))).select("rep", "size", F.xxhash64("root", "step").alias("block"))
    # First the columns of the lowest hashes: what they leave possible is little, and only that is multiplied whole.
    possible = keep(components(_block_links(docs, first, words, share, part, LOW)), "possible")
    nodes = possible.select(F.col("node").alias("rep"), F.col("root").alias("block")).unionByName(possible.select(F.col("root").alias("rep"), F.col("root").alias("block")).distinct())
    joined = components(_block_links(docs, rows.select("rep", "size").distinct().join(nodes, "rep"), words, share, part))
    found = classes.join(joined.toDF("rep", "root"), "rep", "left").where("n > 1 or root is not null").select("set_key", F.coalesce("root", "rep").alias("component"))
    found = few(keep(found, "found"), F.lit(64))
    return described.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op5_ngram_jaccard(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
