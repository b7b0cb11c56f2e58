"""Evaluation questions made from a corpus: single-hop, multi-hop and unanswerable ones, to a quota for each language.

A writer, like any provider, turns columns into columns; it may fail for a row (null), and what it claims to be absent from the
corpus is looked for. Where questions fall away, further candidates refill the quota in a fixed order, so the same corpus and
writer give the same questions.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import evaluation as V
from siftline.operators import metrics as A
from siftline.sources.shared import kept

RECORD = ("id", "language", "question", "question_type", "chunk_ids", "document", "section", "pages", "points")
PAIRS, TARGET, ROUNDS = 4, 15, 3  # multi-hop questions of a language; unanswerable ones in all; rounds of candidates for these


class Writer(Protocol):
    """Each gives a struct (question, points), null where it fails; unanswerable an array of structs (question, terms)."""

    def single_hop(self, content: Column) -> Column: ...

    def multi_hop(self, first: Column, second: Column) -> Column: ...

    def unanswerable(self, language: Column, n: Column, turn: int) -> Column: ...


@dataclass
class PlainWriter:
    """Asks for the text around a text's first words; invents names for what can't be answered."""

    words: int = 6

    def _about(self, content: Column) -> Column:
        return F.array_join(F.slice(F.filter(F.split(content, r"\s+"), lambda w: w != ""), 1, self.words), " ")

    def _point(self, content: Column) -> Column:
        return F.get(F.split(F.trim(content), r"(?<=[.!?])\s+"), 0)

    def single_hop(self, content: Column) -> Column:
        about = self._about(content)
        return F.when(about != "", F.struct(F.concat(F.lit("What follows "), about, F.lit("?")).alias("question"), F.array(self._point(content)).alias("points")))

    def multi_hop(self, first: Column, second: Column) -> Column:
        a, b = self._about(first), self._about(second)
        return F.when((a != "") & (b != ""), F.struct(F.concat(F.lit("What have "), a, F.lit(" and "), b, F.lit(" in common?")).alias("question"), F.array(self._point(first), self._point(second)).alias("points")))

    def unanswerable(self, language: Column, n: Column, turn: int) -> Column:
        name = lambda i: F.concat(F.lit("Zq"), F.lower(F.hex(F.xxhash64(language, F.lit(turn), i))))
        return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.struct(F.concat(F.lit("Who founded "), name(i), F.lit("?")).alias("question"), F.array(name(i)).alias("terms")))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(*RECORD)


def single_hop(chunks: DataFrame, writer: Writer) -> DataFrame:
    """Records of evenly spaced substantive chunks of each document: three to ten, a sixth of them."""
    rows = V.substantive(chunks)
    picked = A.even_sample(rows.select("document_id", "ord"), "document_id", "ord")
    out = rows.join(picked, ["document_id", "ord"]).withColumn("_q", writer.single_hop(F.col("content"))).where("_q is not null")
    one = lambda c: F.array(c)
    return _records(out.select(
        F.concat_ws("-", F.lower("language"), F.left(F.col("document_id").cast("string"), F.lit(8)), F.col("ord").cast("string")).alias("id"), "language", "_q.question", F.lit("single_hop").alias("question_type"),
        one("chunk_id").alias("chunk_ids"), F.col("document_id").alias("document"), F.coalesce("title", F.lit("")).alias("section"), one("page").alias("pages"), "_q.points",
    ))


def multi_hop(chunks: DataFrame, writer: Writer, pairs: int = PAIRS) -> DataFrame:
    """Records of pairs of chunks of neighbouring documents: the first `pairs` attempts of each language that the writer can use."""
    rows = V.substantive(chunks)
    met = V.multi_hop_pairs(rows.select("document_id", "language", "ord", "chunk_id"))
    body = lambda n: rows.select(F.col("chunk_id").alias(n), F.struct("document_id", "ord", "page", "title", "content").alias(f"_{n}"))
    out = met.join(body("first"), "first").join(body("second"), "second").withColumn("_q", writer.multi_hop(F.col("_first.content"), F.col("_second.content"))).where("_q is not null")
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("language").orderBy("attempt"))).where(F.col("_r") <= pairs)
    name = lambda n: F.concat_ws("-", F.left(F.col(f"_{n}.document_id").cast("string"), F.lit(8)), F.col(f"_{n}.ord").cast("string"))
    return _records(out.select(
        F.concat_ws("-", F.lit("mh"), F.lower("language"), name("first"), name("second")).alias("id"), "language", "_q.question", F.lit("multi_hop").alias("question_type"),
        F.array("first", "second").alias("chunk_ids"), F.col("_first.document_id").alias("document"), F.coalesce("_first.title", F.lit("")).alias("section"), F.array("_first.page", "_second.page").alias("pages"), "_q.points",
    ))


def unanswerable(chunks: DataFrame, writer: Writer, targets: dict[str, int], rounds: int = ROUNDS) -> DataFrame:
    """Records of questions none of whose terms is in the corpus. Each round asks for twice as many candidates as a language still
    lacks and keeps the first of those that are absent; questions already kept don't count again."""
    spark = chunks.sparkSession
    good = kept(spark.createDataFrame([], "language string, turn int, place int, question string"), "unanswerable")
    for turn in range(rounds):
        have = {r.language: r["count"] for r in good.groupBy("language").count().collect()}  # a number for each language
        lacks = [(k, n - have.get(k, 0)) for k, n in targets.items() if n > have.get(k, 0)]
        if not lacks:
            break
        asked = spark.createDataFrame(lacks, "language string, lacks int")
        probes = asked.select("language", "lacks", F.posexplode(writer.unanswerable(F.col("language"), 2 * F.col("lacks"), turn)).alias("place", "_q"))
        probes = kept(probes.select("language", "lacks", "place", F.concat_ws("|", "language", "place").alias("id"), "_q.question", "_q.terms"), "probes")
        new = V.absent_terms(probes.select("id", "terms"), chunks.select("content")).select("id")
        new = probes.join(new, "id").dropDuplicates(["language", "question"]).join(good.select("language", "question"), ["language", "question"], "left_anti")
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy("language").orderBy("place"))).where("_r <= lacks")
        good = kept(good.unionByName(new.select("language", F.lit(turn).alias("turn"), "place", "question")), "unanswerable")
    number = F.row_number().over(Window.partitionBy("language").orderBy("turn", "place"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    empty = {"chunk_ids": none("bigint"), "document": F.lit(None).cast("bigint"), "section": F.lit(""), "pages": none("int"), "points": none("string")}
    return _records(good.withColumns({"id": F.concat_ws("-", F.lit("ua"), F.lower("language"), number.cast("string")), "question_type": F.lit("unanswerable"), **empty}))


def generate(chunks: DataFrame, writer: Writer | None = None, pairs: int = PAIRS, targets: dict[str, int] | None = None) -> DataFrame:
    """The records of all three kinds from chunks (chunk_id, document_id, ord, page, title, content, language). targets: unanswerable
    questions of each language; by default TARGET, half of them English and half German."""
    writer = writer or PlainWriter()
    targets = targets if targets is not None else {"EN": -(-TARGET // 2), "DE": TARGET // 2}
    return single_hop(chunks, writer).unionByName(multi_hop(chunks, writer, pairs)).unionByName(unanswerable(chunks, writer, targets))


def golden(records: DataFrame) -> DataFrame:
    """Records as retrieval.evaluated takes them: numbered by a hash of their id."""
    return records.withColumns({"query_id": F.xxhash64("id"), "text": F.col("question")})
