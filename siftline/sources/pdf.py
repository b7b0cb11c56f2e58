"""Text of PDF files by their text operators alone: a last resort without page numbers, in bounded memory and linear time."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = 1 << 20  # characters of the rows that a task holds back
INFLATED = 25 << 20  # bytes of a stream at most; a larger one counts as unreadable
_SCOPE = re.compile(r"BT.*?ET", re.S)
_STRING = r"\((?:\\.|[^\\)])*\)|<[0-9A-Fa-f\s]+>"
_SHOWN = re.compile(rf"\[((?:\\.|[^\]\\])*)\]\s*TJ|({_STRING})\s*(?:Tj|'|\")", re.S)
_ONE = re.compile(_STRING, re.S)
_STREAM = re.compile(rb">>\s*stream\r?\n")
_HEAD = 8192  # bytes before a stream in which its dictionary is looked for
_FLATE = re.compile(rb"/Filter\s*(?:\[\s*)?/FlateDecode\b")
_ESCAPE = re.compile(r"\\([0-7]{1,3}|.)", re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _literal(x: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else _NAMED.get(m[1], m[1]), x)


def _hexadecimal(x: str) -> str:
    digits = re.sub("[^0-9A-Fa-f]", "", x)
    data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return data.decode("utf-16", "replace")
    wide = len(data) % 2 == 0 and data and data[::2].count(0) / (len(data) / 2) >= 0.3
    return data.decode("utf-16-be", "replace") if wide else data.decode("latin-1")


def sanitized(x: str) -> str:
    x = re.sub(r"[ \t]+", " ", re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", x))
    return re.sub(r"\n{3,}", "\n\n", x).strip()


def shown(content: str) -> Iterator[str]:
    """The strings that text operators show."""
    for scope in _SCOPE.findall(content) or [content]:
        for m in _SHOWN.finditer(scope):
            for s in _ONE.findall(m[1]) if m[1] is not None else [m[2]]:
                if text := sanitized(_literal(s[1:-1]) if s[0] == "(" else _hexadecimal(s)):
                    yield text


def inflated(data: bytes) -> str | None:
    """A stream's content, or null if it can't be read or is larger than the bound."""
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            reader = zlib.decompressobj(bits)
            out = reader.decompress(data, INFLATED)
            return out.decode("latin-1") if reader.eof or not reader.unconsumed_tail else None
        except zlib.error:
            continue
    return None


def scraped(data: bytes) -> str:
    """All shown strings of a file, of its own bytes first, then of its compressed streams."""
    found = list(shown(data.decode("latin-1")))
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        head = data[max(0, m.start() - _HEAD) : m.start()].rpartition(b"endstream")[2]
        if end > m.end() and _FLATE.search(head) and (content := inflated(data[m.end() : end].rstrip(b"\r\n"))):
            found += shown(content)
    return sanitized("\n".join(found))


Reader = Callable[[bytes], list[tuple[int, str]]]


def pages(files: DataFrame, reader: Reader | None = None, attempts: int = 2) -> DataFrame:
    """(path, page, text, method) of files (path, content): by the reader, if one is given, tried `attempts` times; where it
    fails or finds no text, by scraping, as page 1. A file without any text is one empty page."""

    def read(data: bytes) -> Iterator[tuple[int, str, str]]:
        for _ in range(attempts if reader else 0):
            try:
                got = reader(data)
            except Exception:  # noqa: BLE001  whatever a foreign reader raises, the file is scraped instead
                continue
            if any(t.strip() for _, t in got):
                yield from ((n, t, "reader") for n, t in got)
                return
        yield 1, scraped(data), "byte_scrape"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file at a time; rows leave when they hold SENT characters."""
        rows, held = [], 0
        for b in batches:
            for i in range(b.num_rows):
                for row in read(b.column(1)[i].as_py() or b""):
                    rows.append((b.column(0)[i].as_py(), *row))
                    held += len(row[1]) + 100
                if held > SENT:
                    yield sent(rows)
                    rows, held = [], 0
        if rows:
            yield sent(rows)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "page", "text", "method"])

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "path string, page int, text string, method string")
