"""A transactional sink for answer events: a Python data source whose streaming writer commits each micro-batch once.

Every task writes one file of JSON lines under _data; the driver's commit of a micro-batch is one small file under _log that names
the tasks' files. Readers take the files that a commit names, so what failed or repeated tasks and batches leave isn't seen,
and a batch that runs again after its commit changes nothing. The log is kept by the query's name, since every query
counts its batches from 0.

    spark.dataSource.register(AnswerEvents)
    event_rows(answers).writeStream.format("answer_events").option("name", "api").option("path", folder)...
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = "query_id long, seq int, event string, data string"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class AnswerEventsWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def write(self, iterator: Iterator[Row]) -> Written:
        """One file of a task's events. Those of an answer must come in order, as event_rows makes them."""
        store, path = _store(self.folder)
        file, n, at = f"{uuid.uuid4().hex}.json", 0, (None, -1)
        store.create_dir(f"{path}/_data", recursive=True)
        with store.open_output_stream(f"{path}/_data/{file}") as out:
            for row in iterator:
                if row["query_id"] == at[0] and row["seq"] <= at[1]:
                    raise ValueError(f"events of answer {at[0]} are out of order")
                at = (row["query_id"], row["seq"])
                out.write((json.dumps({c: row[c] for c in ("query_id", "seq", "event", "data")}, ensure_ascii=False) + "\n").encode())
                n += 1
        if not n:
            store.delete_file(f"{path}/_data/{file}")
        return Written(file if n else None, n)

    def _entry(self, batch: int) -> tuple[fs.FileSystem, str, str]:
        store, path = _store(self.folder)
        return store, path, f"{path}/_log/{self.name}/{batch:012}.json"

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        """The batch's files count from now on; if the batch is committed already, they go."""
        store, path, entry = self._entry(batchId)
        if store.get_file_info(entry).is_file:
            self.abort(messages, batchId)
            return
        store.create_dir(entry.rpartition("/")[0], recursive=True)
        draft = f"{entry.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps({"batch": batchId, "files": [m.file for m in messages if m and m.file], "rows": sum(m.rows for m in messages if m)}).encode())
        store.move(draft, entry)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, path, _ = self._entry(batchId)
        for m in messages:
            if m and m.file and store.get_file_info(f"{path}/_data/{m.file}").is_file:
                store.delete_file(f"{path}/_data/{m.file}")


class AnswerEvents(DataSource):
    """Options: path, a folder or URI that all executors reach; name, the query's."""

    @classmethod
    def name(cls) -> str:
        return "answer_events"

    def schema(self) -> str:
        return ROWS

    def streamWriter(self, schema: StructType, overwrite: bool) -> AnswerEventsWriter:
        return AnswerEventsWriter(self.options["path"], self.options.get("name", "answers"))


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The events (query_id, seq, event, data) of all committed batches of all queries."""
    store, path = _store(folder)
    entries = store.get_file_info(fs.FileSelector(f"{path}/_log", recursive=True, allow_not_found=True))
    files: list[str] = []
    for x in sorted(entries, key=lambda x: x.path):
        if x.is_file and not x.base_name.startswith("."):
            with store.open_input_stream(x.path) as f:
                files += json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).json([f"{folder.rstrip('/')}/_data/{f}" for f in files])


def frames(events: DataFrame) -> DataFrame:
    """(query_id, body): what a client is sent of each answer, an event and its data in each frame, in order."""
    frame = F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json(F.struct("data")), F.lit("\n\n"))
    rows = events.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", frame.alias("f")))).alias("_l"))  # one answer's frames
    return rows.select("query_id", F.array_join(F.col("_l.f"), "").alias("body"))
