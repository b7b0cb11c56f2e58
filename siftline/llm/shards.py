"""Training-order materialisation: fixed-stride token shards in the order of a keyed permutation.

Texts are tokenized once, into a table of sequences in the shared folder that is dropped when the shards are there. Sequences
are numbered as that table's parts hold them; a count of each part gives its first number. A Feistel network over the next even power of two, walked until it falls below the number of
sequences, gives each number its slot; so any slot's sequence, and any sequence's slot, is known without a table. A shard
holds a range of slots at a fixed stride, and a task a range of shards: record i of a shard begins at byte i * stride, so a reader can resume anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch, small_batches
from .files import forget, forget_others, located, make_dir
from .tokens import word_ids

LENGTH, SLOTS, KEY, ROUNDS = 2048, 4096, 20240101, 6
PAD = 0xFFFF


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    h = (x + np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _half(n: int) -> int:
    """Bits of each half of the network over at least n values."""
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def permuted(numbers: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, backwards: bool = False) -> np.ndarray:
    """The slots of sequence numbers below n, or the numbers of slots if backwards: a bijection on 0..n-1 for each key."""
    bits = np.uint64(_half(n))
    mask = np.uint64((1 << int(bits)) - 1)
    order = range(rounds - 1, -1, -1) if backwards else range(rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for r in order:
            if backwards:
                left, right = right ^ (_mixed(left, key * 1_000_003 + r) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, key * 1_000_003 + r) & mask)
        return left << bits | right

    x = once(np.asarray(numbers, np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int) -> Iterator[tuple[bytes, list[dict]]]:
    """The partition's documents, each with its end id, one after the other, cut at `length` ids: bytes (two for each id) and spans."""
    held, spans, encode = bytearray(), [], word_ids(path).encode
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(encode(text or "") + end_id.to_bytes(4, "little"), "<u4").astype("<u2").tobytes()
            at = 0
            while at < len(ids):
                part = ids[at : at + 2 * length - len(held)]
                spans.append({"doc_id": doc, "start": at // 2, "length": len(part) // 2, "offset": len(held) // 2})
                held += part
                at += len(part)
                if len(held) == 2 * length:
                    yield bytes(held), spans
                    held, spans = bytearray(), []
    if held:
        yield bytes(held), spans


_SPAN = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())]))
_SPANS = "spans array<struct<doc_id: long, start: long, length: long, offset: long>>"


def _cutter(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, first = TaskContext.get().partitionId(), [], 0

        def out() -> pa.RecordBatch:
            ids, spans = zip(*rows, strict=True)
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(ids, pa.binary()), pa.array(spans, _SPAN)]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "ids", "spans"])

        for row in _sequences(batches, path, end_id, length):
            rows.append(row)
            if len(rows) == 500:
                yield out()
                rows, first = [], first + 500
        if rows:
            yield out()

    return run


def _slots(first: dict[int, int], total: int, key: int):
    @F.pandas_udf("long")
    def run(part: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permuted(part.map(first).to_numpy(np.int64) + number.to_numpy(np.int64), total, key))

    return run


def _writer(folder: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        at, out, name, rows, i = None, None, "", [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), _SPAN), strict=True)], ["shard", "file", "record", "slot", "spans"])
        for b in batches:
            for shard, slot, ids, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != at:
                    if out is not None:
                        out.close()
                    at, i, name = shard, 0, f"shard-{shard:08d}-{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(ids + PAD.to_bytes(2, "little") * (length - len(ids) // 2))
                rows.append((shard, name, i, slot, spans))
                i += 1
            if rows:
                yield batch()
                rows = []
        if out is not None:
            out.close()

    return run


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """Writes docs (doc_id, text) as shards of `slots` records of `length` 16-bit ids, and returns their index: shard, file,
    record, slot and the spans of documents in each record. The index is a table in the shared folder.

    The last record of each input partition is padded with 0xFFFF. A null text counts as empty and has its end id only.
    Repeated rows are documents of their own. Other columns are ignored; an empty table writes no shard."""
    if max(word_ids(path).whole.get_vocab_size(), end_id + 1) > PAD:
        raise ValueError("16-bit shards need a vocabulary below 65,535 ids")
    make_dir(folder)
    spark = docs.sparkSession
    small_batches(spark)
    cut = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(path, end_id, length), f"part int, number long, ids binary, {_SPANS}")
    cut.write.option("compression", "zstd").parquet(at := scratch(spark, "sequences"))
    cut = spark.read.schema(cut.schema).parquet(at)
    first, total = {}, 0
    for part, n in sorted(map(tuple, cut.groupBy("part").count().collect())):  # a row for each partition
        first[part] = total
        total += n
    slot = _slots(first, total, key)("part", "number")
    placed = cut.select(slot.alias("slot"), "ids", "spans").select(F.expr(f"slot div {slots}").alias("shard"), "slot", "ids", "spans")
    written = placed.repartitionByRange("shard").sortWithinPartitions("shard", "slot").mapInArrow(_writer(folder, length), f"shard long, file string, record long, slot long, {_SPANS}")
    index = keep(written, "shard-index")
    forget(at)
    forget_others(folder, {r[0] for r in index.select("file").distinct().toLocalIterator()})
    return index


def _reader(folder: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = located(folder)
        name, f = None, None
        for b in batches:
            got = []
            for file, record in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, store.open_input_file(f"{root}/{file}")
                got.append(f.read_at(2 * length, record * 2 * length))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, "ids"])
        if f is not None:
            f.close()

    return run


def read_shards(index: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """The index's records with their bytes (column ids: `length` little-endian 16-bit ids), each shard read in order."""
    schema = index.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return index.repartition("file").sortWithinPartitions("file", "record").mapInArrow(_reader(folder, length), f"{schema}, ids binary")


def op9_shards(spark, sf_dir):
    """One row for each piece of a document: its place in the training order, and the CRC-32 of its bytes read back."""
    folder = scratch(spark, "shards")
    path = public_tokenizers.path("word_bpe_49k.json")
    index = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, path, 2)
    rows = read_shards(index, folder).select("shard", "record", "slot", "ids", F.explode("spans").alias("s"))
    ids = F.substring("ids", 2 * F.col("s.offset") + 1, 2 * F.col("s.length"))
    return rows.select("s.doc_id", "s.start", "s.length", "slot", "shard", "record", "s.offset", F.crc32(ids).alias("ids_crc32"))
