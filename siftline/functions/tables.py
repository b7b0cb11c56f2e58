"""Table functions: Python UDTFs over TABLE arguments, one call for each partition, for those who write SQL.

    SELECT * FROM consume_rate_limit(TABLE(SELECT bucket, ts, hit_id FROM hits) PARTITION BY bucket ORDER BY (ts, hit_id), 20, 86400)
    SELECT * FROM match_document_chunks(TABLE(SELECT * FROM sides) PARTITION BY part ORDER BY (side, id), 8)
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

BATCH = 1024  # rows whose vectors are multiplied at once


@udtf(returnType="hit_id bigint, bucket bigint, request_count bigint, allowed boolean, remaining bigint, retry_after bigint")
class ConsumeRateLimit:
    """Fixed windows over the hits (bucket, ts, hit_id) of one bucket in order of time: the rows of operators.state.rate_limit. Hits
    without a bucket give no row."""

    def __init__(self) -> None:
        self.start, self.n = 0, 0

    def eval(self, hit: Row, most: int, seconds: int) -> Iterator[tuple]:
        if hit["bucket"] is None:
            return
        ts: datetime = hit["ts"]
        gone = (ts if ts.tzinfo else ts.replace(tzinfo=UTC)) - datetime(1970, 1, 1, tzinfo=UTC)
        t, width = (gone.days * 86_400 + gone.seconds) * 1_000_000 + gone.microseconds, seconds * 1_000_000
        if not self.n or self.start + width <= t:
            self.start, self.n = t, 0
        self.n += 1
        yield hit["hit_id"], hit["bucket"], self.n, self.n <= most, max(most - self.n, 0), max(-(-(self.start + width - t) // 1_000_000), 1)


@udtf(returnType="query_id bigint, chunk_id bigint, similarity double")
class MatchDocumentChunks:
    """The k most similar chunks of each query among one part's rows (part, side, id, embedding): queries with side 0, then chunks with
    side 1. It holds the part's queries and k rows for each. Null vectors, and chunks of another length, give no row."""

    def __init__(self) -> None:
        self.k = 0
        self.queries: list[tuple[int, np.ndarray]] = []
        self.ids: np.ndarray | None = None
        self.sims: np.ndarray | None = None
        self.matrix: np.ndarray | None = None
        self.names: list[int] = []
        self.vectors: list[np.ndarray] = []

    @staticmethod
    def unit(vector: list[float] | None) -> np.ndarray | None:
        if not vector or any(x is None for x in vector):
            return None
        x = np.array(vector, np.float64)
        n = np.sqrt((x * x).sum())
        return (x / n if n > 0 else x) if np.isfinite(n) else None

    def eval(self, row: Row, k: int) -> None:
        self.k = max(k, 1)
        x = self.unit(row["embedding"])
        if x is None:
            return
        if row["side"] == 0:
            self.queries.append((row["id"], x))
        elif self.queries and len(x) == len(self.queries[0][1]):
            self.names.append(row["id"])
            self.vectors.append(x)
            if len(self.names) == BATCH:
                self.met()

    def met(self) -> None:
        if self.matrix is None:
            self.matrix = np.stack([x for _, x in self.queries])
            self.ids, self.sims = np.zeros((len(self.queries), 0), np.int64), np.zeros((len(self.queries), 0))
        sims = np.concatenate([self.sims, np.round(self.matrix @ np.stack(self.vectors).T, 6)], 1)
        ids = np.concatenate([self.ids, np.broadcast_to(np.array(self.names, np.int64), (len(sims), len(self.names)))], 1)
        order = np.lexsort((ids, -sims), axis=1)[:, : self.k]
        self.ids, self.sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        self.names, self.vectors = [], []

    def terminate(self) -> Iterator[tuple]:
        if self.names:
            self.met()
        for (query, _), ids, sims in zip(self.queries, self.ids if self.ids is not None else (), self.sims if self.sims is not None else (), strict=False):
            for chunk, sim in zip(ids.tolist(), sims.tolist(), strict=True):
                yield query, chunk, sim


TABLES = {"consume_rate_limit": ConsumeRateLimit, "match_document_chunks": MatchDocumentChunks}


def register(spark: SparkSession) -> list[str]:
    """Creates the table functions in a session and returns their names."""
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return list(TABLES)


#: The k best chunks of each query by SQL alone: parts of the chunks meet all queries, then each query's rows are ranked.
MATCH = """WITH sides AS (
  SELECT part, 0 AS side, query_id AS id, embedding FROM {queries} LATERAL VIEW explode(sequence(0, {parts} - 1)) p AS part
  UNION ALL SELECT CAST(pmod(xxhash64(chunk_id), {parts}) AS INT), 1, chunk_id, embedding FROM {chunks}),
found AS (SELECT * FROM match_document_chunks(TABLE(sides) PARTITION BY part ORDER BY (side, id), {k})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS ord FROM found)
SELECT query_id, chunk_id, similarity, ord FROM ranked WHERE ord <= {k}"""
LIMIT = "SELECT * FROM consume_rate_limit(TABLE(SELECT bucket, ts, hit_id FROM {hits}) PARTITION BY bucket ORDER BY (ts, hit_id), {most}, {seconds})"
