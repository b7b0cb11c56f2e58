"""Packing token sequences by minimum bin slack.

A document's ids are cut into full pieces of the window's capacity, each a sequence of its own, and one remaining piece.
How many remaining pieces there are of each length (capacity - 1 counts at most) decides the rest: a bitset of reachable
sums picks the multiset of lengths that, with the longest length left, fills a window closest to capacity; backtracking
gives the count of each length; the multiset is used for as many windows as the counts allow. Pieces find their place by
their rank among the pieces of their length, so no group of equal lengths is ever in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_batches
from .tokens import word_ids

CAPACITY = 4096
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def best_fill(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset (length: how many) with the longest length left whose sum is the largest within capacity."""
    longest = max(counts)
    room, reach, layers = capacity - longest, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach >> room:
            n = min(step, left)
            before, reach = reach, (reach | reach << (n * length)) & mask
            if reach != before:
                layers.append((length, n, before))
            left, step = left - n, 2 * step
        if reach >> room:
            break
    out, total = {longest: 1}, reach.bit_length() - 1
    for length, n, before in reversed(layers):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + n
            total -= n * length
    return out


def plan_windows(capacity: int, counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Multisets and for how many windows each is used, until no piece is left."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        fill = best_fill(capacity, counts)
        times = min(counts[k] // n for k, n in fill.items())
        out.append((fill, times))
        for k, n in fill.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def _cutter(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

        for b in batches:
            encode = word_ids(path).encode
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    rows.append((doc, at // 4, len(piece) // 4, len(ids) // 4, piece))
                    held += len(piece) + 100
                if held > 4 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return cut


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of each document's ids with end_id at the end, cut at the capacity.

    ids: little-endian unsigned 32-bit. A null text counts as empty and still has its end id. Other columns are ignored."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(path, end_id, capacity), PIECES)


def _placer(segments: dict[str, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            key = (length << 48) | rank
            i = np.searchsorted(segments["key"], key, "right") - 1
            within = rank - (segments["key"][i] & ((1 << 48) - 1))
            n = segments["each"][i]
            seq = segments["sequence"][i] + within // n
            offset = segments["offset"][i] + within % n * length
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], ["row", "sequence_id", "offset"])

    return place


def assign_sequences(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = 2000) -> DataFrame:
    """Adds sequence_id and offset (replaced if there) to pieces (doc_id, start, length of 1 to capacity, any other columns).

    Sequences have no gaps and hold at most capacity tokens. Ranks are dealt over hashed parts of about salt_rows rows, so
    a length that many pieces share is ranked by many tasks. Repeated rows are pieces of their own."""
    rows = F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("row")  # a name of its own for each column here, whatever theirs are
    salted = keep(pieces.select(rows, "length", F.xxhash64("doc_id", "start").alias("piece_hash")), "pieces")
    by_length = {r[0]: r[1] for r in salted.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    parts = max(1, min(1 << 16, sum(by_length.values()) // salt_rows))
    salted = salted.withColumn("part", F.pmod("piece_hash", F.lit(parts)))
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("length", "part", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "part").orderBy("piece_hash", "row.doc_id", "row.start")) - 1
    ranked = salted.withColumn("own", own).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("own"))

    rows, used, sequence = [], {}, 0
    for fill, times in plan_windows(capacity, by_length):
        offset = 0
        for length, n in sorted(fill.items(), reverse=True):
            rows.append((length << 48 | used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    table = np.array(rows or [(0, 1, 0, 0)], np.int64).T
    segments = dict(zip(("key", "each", "sequence", "offset"), (np.ascontiguousarray(x) for x in table), strict=True))
    placed = ranked.select("row", "length", "rank").mapInArrow(_placer(segments), f"row {pieces.schema.simpleString()}, sequence_id bigint, offset bigint")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*(F.col("row")[c].alias(c) for c in kept), "sequence_id", "offset")


def op1_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
