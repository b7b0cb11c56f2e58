"""BPE encoding by a distinct-word table, decoding by an id-to-piece join.

A word here is a run of white space with the characters up to the next one: byte-level BPE never merges across such a
border, whatever the vocabulary. Texts are read in blocks of about BLOCK characters. Each block sends its distinct words,
sorted, to the owners of their hashes; an owner encodes each word once for all blocks and sends back the ids alone, in the
order of the words. A join by block brings a block's texts (compressed, one row) and ids together: the block's words, sorted
the same way, take their ids by position, and the texts take up their words' ids. A block is named by its input partition
and its place there, the same in both readings; if a block's words and ids don't fit each other, the job fails.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, shuffle_width, small_batches
from .tokens import PieceIds, byte_letters, load

BLOCK = 16_000_000
OWNED = "owner int, block long, words binary, lengths binary"
ENCODED = "block long, owner int, lengths binary, ids binary"
TEXTS = "block long, docs array<long>, lengths binary, texts binary"
_WORD = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A space inside or at the end of a longer run of white space: here cutting at every space would be wrong.
_TRICKY = re.compile(f"[{WHITE}] (?:[{WHITE}]|\\Z)")


def words(text: str) -> tuple[str, list[str]] | list[str]:
    """The words of a text: the first, and the others without their leading space; or all words as they are, if tricky."""
    if _TRICKY.search(text):
        return _WORD.findall(text)
    first, *rest = text.split(" ")
    return first, rest


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[str]]]:
    """Block id, doc ids and texts, in parts; a block's parts follow each other."""
    block, held = TaskContext.get().partitionId() << 24, 0
    for b in batches:
        ids, texts, begin = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()], 0
        for i, x in enumerate(texts):
            held += len(x)
            if held >= size:
                yield block, ids[begin : i + 1], texts[begin : i + 1]
                block, held, begin = block + 1, 0, i + 1
        if begin < len(ids):
            yield block, ids[begin:], texts[begin:]


def _owned(found: set[str], owners: int) -> list[list[str]]:
    """The words of each owner, in order."""
    out: list[list[str]] = [[] for _ in range(owners)]
    for w in found:
        out[zlib.crc32(w.encode()) % owners].append(w)
    for x in out:
        x.sort()
    return out


def _found(texts: list[str], plain: set[str], spaced: set[str]) -> None:
    """Adds the words of texts: those as they are to plain, those after one space to spaced, without it."""
    for x in texts:
        w = words(x)
        if isinstance(w, list):
            plain.update(w)
        else:
            plain.add(w[0])
            spaced.update(w[1])


def _all(plain: set[str], spaced: set[str]) -> set[str]:
    return {x for x in plain if x} | {f" {x}" for x in spaced}


def _lengths(parts: list) -> bytes:
    return np.fromiter(map(len, parts), "<u4", len(parts)).tobytes()


def _distinct(size: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, plain, spaced = None, set(), set()
        packed = zstandard.ZstdCompressor(level=3).compress

        def out() -> pa.RecordBatch:
            rows = [(i, at, packed("".join(x).encode()), packed(_lengths(x))) for i, x in enumerate(_owned(_all(plain, spaced), owners)) if x]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["owner", "block", "words", "lengths"])

        for block, _, texts in _blocks(batches, size):
            if block != at:
                if at is not None:
                    yield out()
                at, plain, spaced = block, set(), set()
            _found(texts, plain, spaced)
        if at is not None:
            yield out()

    return run


def _encoder(path: str):
    """Rows come sorted by owner, whose distinct words are each encoded once; the ids go back in the words' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, owner, known = PieceIds(path).encode, None, {}
        packed, opened = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            if not b.num_rows:
                continue
            for now, block, text, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != owner:
                    owner, known = now, {}
                text, a, ids = opened(text).decode(), 0, []
                for n in np.frombuffer(opened(lengths), "<u4").tolist():
                    w = text[a : a + n]
                    a += n
                    if (x := known.get(w)) is None:
                        x = known[w] = encode(w)
                    ids.append(x)
                rows.append((block, now, packed(_lengths(ids)), packed(b"".join(ids))))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "owner", "lengths", "ids"])

    return run


def _sender(size: int):
    """The texts of each block, compressed in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, docs, texts = None, [], []

        def out() -> pa.RecordBatch:
            packer = zstandard.ZstdCompressor(level=3).compressobj()
            data = b"".join([*map(packer.compress, texts), packer.flush()])
            lengths = zstandard.compress(_lengths(texts))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.binary()), pa.array([data], pa.binary())], ["block", "docs", "lengths", "texts"])

        for block, some, found in _blocks(batches, size):
            if block != at:
                if texts:
                    yield out()
                at, docs, texts = block, [], []
            docs += some
            texts += [x.encode() for x in found]
        if texts:
            yield out()

    return run


def _pieces_of(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _joiner(owners: int):
    """Each row is a block: its texts, and the ids of its words by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x)

        def block_ids(block: int, docs: list, lengths: bytes, data: bytes, sent: list[dict]) -> Iterator[pa.RecordBatch]:
            texts = [x.decode() for x in _pieces_of(opened(data), np.frombuffer(opened(lengths), "<u4"))]
            ids = {x["owner"]: x for x in sent}
            plain, spaced = set(), set()
            _found(texts, plain, spaced)
            one: dict[str, bytes] = {"": b""}
            after: dict[str, bytes] = {}
            for i, found in enumerate(_owned(_all(plain, spaced), owners)):
                got = ids.pop(i, None)
                counts = np.frombuffer(opened(got["lengths"]), "<u4") if got else ()
                if len(counts) != len(found):
                    raise ValueError(f"block {block}: {len(found)} words of owner {i}, ids of {len(counts)}")
                for w, x in zip(found, _pieces_of(opened(got["ids"]), counts) if got else (), strict=True):
                    if w[0] == " ":
                        after[w[1:]] = x
                    else:
                        one[w] = x
            if ids:
                raise ValueError(f"block {block}: ids of words that it hasn't")
            for j in range(0, len(texts), 500):
                rows = []
                for x in texts[j : j + 500]:
                    w = words(x)
                    rows.append(b"".join([after[y[1:]] if y[0] == " " else one[y] for y in w]) if isinstance(w, list) else one[w[0]] + b"".join(map(after.__getitem__, w[1])))
                offsets = np.cumsum([0, *(len(x) // 4 for x in rows)], dtype=np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays([pa.array(docs[j : j + 500], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"])

        for b in batches:
            for i in range(b.num_rows):
                yield from block_ids(*(c[i].as_py() for c in b.columns))

    return run


def word_ids(docs: DataFrame, path: str, owners: int, block: int = BLOCK) -> DataFrame:
    """The ids of each block's distinct words: a row for each block and owner of words."""
    found = docs.mapInArrow(_distinct(block, owners), OWNED)
    return found.repartition("owner").sortWithinPartitions("owner", "block").mapInArrow(_encoder(path), ENCODED)


def encode(docs: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text of docs (doc_id, text), as the tokenizer file's library gives them
    without added special tokens; strings of special tokens in a text are those tokens.

    A null text counts as empty and has no ids. Repeated rows stay; other columns are ignored."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    owners = 4 * shuffle_width(docs.sparkSession)
    sent = word_ids(docs, path, owners, block).groupBy("block").agg(F.collect_list(F.struct("owner", "lengths", "ids")).alias("sent"))
    texts = docs.mapInArrow(_sender(block), TEXTS)
    joined = texts.join(sent, "block", "left").select("block", "docs", "lengths", "texts", F.coalesce("sent", F.array().cast(sent.schema["sent"].dataType)).alias("sent"))
    return joined.mapInArrow(_joiner(owners), "doc_id long, ids array<int>")


def pieces(path: str) -> dict[int, bytes]:
    """The id-to-piece table of a byte-level vocabulary file: one entry for each of its ids, special tokens included."""
    tokenizer = load(path)
    value = {c: b for b, c in byte_letters().items()}
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return {i: bytes(map(value.__getitem__, p)) for p, i in tokenizer.get_vocab(with_added_tokens=False).items()} | special


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = None
        for b in batches:
            if piece is None:
                table = pieces(path)
                piece = pa.array([table.get(i) for i in range(max(table) + 1)], pa.large_binary())
            ids = b.column("ids")
            at, flat, there = ids.offsets.to_pylist(), ids.values, ids.is_valid().to_pylist()
            joined = pc.take(piece, flat)  # each id's piece; an id beyond the table is an error
            if joined.null_count:
                raise ValueError("an id without a piece")
            _, ends, data = joined.buffers()
            ends = np.frombuffer(ends, np.int64)[joined.offset :] if ends is not None else np.zeros(1, np.int64)
            data = memoryview(data) if data is not None else b""
            texts = [str(data[ends[at[i]] : ends[at[i + 1]]], "utf-8", "replace") if ok else None for i, ok in enumerate(there)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds column decoded, the text of column ids (array<int>): each id joined to its piece, special tokens kept.

    The id-to-piece side is the vocabulary file's, so each task holds it whole: about 50,000 entries, however large the
    input. Bytes that are no UTF-8 become U+FFFD; null ids decode to null; an id outside the vocabulary is an error."""
    schema = encoded.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return encoded.mapInArrow(_decoder(path), f"{schema}, decoded string")


def op2_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
