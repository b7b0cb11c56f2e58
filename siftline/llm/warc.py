"""WARC archives with an index first: offset, length, URL and digest of each record, then coalesced byte-range reads.

Each record is a gzip member of its own, so that a range of the file is readable by itself. A writing task names its files
after its attempt; only files that the committed index names are ever read, so a repeated or lost task does no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, keep, scratch, small_batches
from .files import forget_others, located, make_dir

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
ROLL = 1 << 30  # bytes after which a task begins another file
GAP, CHUNK = 64 << 10, 8 << 20  # ranges closer than GAP are read at once, CHUNK bytes at most unless one record is longer
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that names the response with the same payload."""
    uri = "".join(c if "\x20" < c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in (url or f"urn:page:{page_id}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda x: None if x == "<urn:page:None>" else int(x.removeprefix("<urn:page:").removesuffix(">"))
    whole = field["WARC-Type"] == "response"
    return {"page_id": number(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "payload": payload if whole else None, "payload_bytes": size, "payload_digest": field["WARC-Payload-Digest"].partition(":")[2], "record_type": field["WARC-Type"], "refers_to": None if whole else number(field["WARC-Refers-To"])}


def _writer(folder: str, date: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = located(folder)
        out, name, at, rows = None, "", 0, []
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(record(page, url, payload, digest, refers, date), 1, mtime=0)
                out.write(member)
                rows.append({"page_id": page, "url": url, "file": name, "offset": at, "length": len(member), "payload_bytes": len(payload), "payload_digest": digest, "record_type": "response" if refers is None else "revisit", "refers_to": refers})
                at += len(member)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return write


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = located(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        name, f = None, None

        def spans(rows: list[tuple]) -> Iterator[list[tuple]]:
            """Sorted rows (file, offset, length), gathered into ranges that one read covers."""
            run: list[tuple] = []
            for r in rows:
                if run and (r[0] != run[0][0] or r[1] - (run[-1][1] + run[-1][2]) > GAP or r[1] + r[2] - run[0][1] > CHUNK):
                    yield run
                    run = []
                run.append(r)
            if run:
                yield run

        for b in batches:
            for run in spans(list(zip(*(c.to_pylist() for c in b.columns), strict=True))):
                if run[0][0] != name:
                    if f is not None:
                        f.close()
                    name, f = run[0][0], store.open_input_file(f"{path}/{run[0][0]}")
                begin = run[0][1]
                data = memoryview(f.read_at(run[-1][1] + run[-1][2] - begin, begin))
                found = []
                for _, offset, length in run:
                    x = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    if x["payload"] is not None and hashlib.sha256(x["payload"]).hexdigest() != x["payload_digest"]:
                        raise ValueError(f"{name} at {offset}: the payload doesn't fit its digest")
                    found.append(x)
                yield pa.RecordBatch.from_pylist(found, schema)
        if f is not None:
            f.close()

    return read


def write_archives(pages: DataFrame, folder: str, least: int = 100, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Writes an archive record for each row of pages (page_id, url, html) and returns the index, a table in the shared folder.

    A null html is an empty payload, a null URL becomes urn:page:<page_id>; line breaks in URLs are escaped. Of equal
    payloads of `least` bytes or more that with the smallest page_id is the response, the others revisit it. Repeated rows
    of that page_id are all responses. Other columns are ignored.
    A null page_id is always a response, named urn:page:None, and comes back as null. An empty table writes no file."""
    make_dir(folder)
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    first = pages.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    # Payloads stay where they lie unless repeated digests are too many to send, so a page that many share is no hot key.
    typed = pages.join(few(keep(first, "repeated"), F.lit(100)), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    index = keep(typed.mapInArrow(_writer(folder, date, roll), INDEX), "warc-index")
    # One row for each file, so that orphans of lost attempts can go.
    forget_others(folder, {r[0] for r in index.select("file").distinct().toLocalIterator()})
    return index


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows `selected` (file, offset, length) name, parsed and checked against their digests.

    Rows are dealt by file and range of 64 MB, sorted by offset; neighbours are fetched by one read."""
    ranges = selected.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (64 << 20)))
    return ranges.sortWithinPartitions("file", "offset").mapInArrow(_reader(folder), READ)


def op8_warc(spark, sf_dir):
    folder = scratch(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM q
"""
