"""Answers and what they cite: blocks of an answer's text, citation markers, source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.columns import let

# Titles of sources that have none, or that are gone.
UNTITLED, GONE = "Unbenanntes Dokument", "Nicht mehr vorhandenes Dokument"


def answer_blocks(text: Column, most_chars: int = 80, most_words: int = 10) -> Column:
    """An array of (kind, number, content): the parts between blank lines as bullets, numbered items, subheadings or body."""
    part = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def block(x: Column) -> Column:
        bullet, number = F.regexp_extract(x, r"^[-*•]\s+(.+)", 1), F.regexp_extract(x, r"^(\d+)[.)]\s+(.+)", 1)
        short = (F.length(x) < most_chars) & ~x.endswith(".") & ~x.contains("\n") & (F.size(F.split(x, " ")) <= most_words)
        kind = F.when(bullet != "", "bullet").when(number != "", "numbered").when(short, "subheading").otherwise("body")
        content = F.when(bullet != "", bullet).when(number != "", F.regexp_extract(x, r"^(\d+)[.)]\s+(.+)", 2)).otherwise(x)
        return F.struct(kind.alias("kind"), F.when(kind == "numbered", number).alias("number"), content.alias("content"))

    return F.transform(part, block)


def cited(answer: Column, n_evidence: Column) -> Column:
    """The distinct evidence numbers that an answer's markers, such as [2] or [1, 3], name, in order of appearance and as
    (valid, out_of_range); other brackets are no markers."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[(\d{1,6}(?:\s*,\s*\d{1,6})*)\]"), F.lit(1))
    numbers = F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: x.cast("int")))
    good = lambda x: (x >= 1) & (x <= n_evidence)
    return F.struct(F.filter(numbers, good).alias("valid"), F.size(F.filter(numbers, lambda x: ~good(x))).alias("out_of_range"))


MARKER = r"([ \t]*)\[(\d+(?:\s*,\s*\d+)*)\]"


def _numbers(group: Column) -> Column:
    """A marker's numbers; more than nine digits name nothing."""
    return F.transform(F.split(group, r"\s*,\s*"), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def resolve_citations(answer: Column, n_evidence: Column) -> Column:
    """A struct (answer, cited, invalid, fell_back): the answer without markers of evidence that isn't there, the evidence
    numbers (from 1) it names by first appearance (all of them if it names none), and how many markers named nothing.

    Without evidence the answer stays as it is. Markers like [WEB-1] are none."""

    def done(x: Column) -> Column:
        good = lambda i: (i >= 1) & (i <= n_evidence)
        all_ = F.flatten(F.transform(x.lists, _numbers))

        def written(i: Column) -> Column:
            numbers, group = _numbers(F.get(x.lists, i)), F.get(x.found, i)
            kept = F.filter(numbers, good)
            lead = F.get(x.leads, i)
            return F.when(F.size(kept) == 0, F.lit("")).when(F.size(kept) == F.size(numbers), group).otherwise(F.concat(lead, F.lit("["), F.array_join(kept.cast("array<string>"), ", "), F.lit("]")))

        n = F.size(x.found)
        text = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.get(x.parts, i), F.when(i < n, written(i)).otherwise(F.lit("")))), "")
        cited = F.array_distinct(F.filter(all_, good))
        every = F.when(n_evidence > 0, F.sequence(F.lit(1), n_evidence)).otherwise(F.array().cast("array<int>"))
        none = F.size(cited) == 0
        out = F.struct(text.alias("answer"), F.when(none, every).otherwise(cited).alias("cited"), F.size(F.filter(all_, lambda i: ~good(i))).alias("invalid"), none.alias("fell_back"))
        plain = F.struct(answer.alias("answer"), F.array().cast("array<int>").alias("cited"), F.lit(0).alias("invalid"), F.lit(False).alias("fell_back"))
        return F.when(n_evidence > 0, out).otherwise(plain)

    group = lambda k: F.regexp_extract_all(answer, F.lit(MARKER), F.lit(k))
    return let(F.struct(F.split(answer, MARKER, -1).alias("parts"), group(0).alias("found"), group(1).alias("leads"), group(2).alias("lists")), done)


def sentences(text: Column) -> Column:
    """The parts between ends of sentences and white space after them, trimmed; empty ones left out."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def cited_sentences(answer: Column, n_evidence: Column) -> Column:
    """An array of (sentence, cited) of the sentences with a marker of evidence that is there, numbers from 1 by appearance."""
    def numbers(x: Column) -> Column:
        return F.array_distinct(F.filter(F.flatten(F.transform(F.regexp_extract_all(x, F.lit(MARKER), F.lit(2)), _numbers)), lambda i: (i >= 1) & (i <= n_evidence)))

    return F.filter(F.transform(sentences(answer), lambda x: F.struct(x.alias("sentence"), numbers(x).alias("cited"))), lambda s: F.size(s.cited) > 0)


def distinct_citations(rows: DataFrame) -> DataFrame:
    """The first of each answer's citations (answer_id, ord, document_id, page, chunk_id) that name the same place."""
    key = ["answer_id", "document_id", "page", "chunk_id"]
    return rows.groupBy(*key).agg(F.min("ord").alias("ord"))


def valid_citations(citations: Column) -> Column:
    """Of an array of (document_id, page, chunk_id) strings, those with both ids and a page above 0, as a number."""
    page = lambda c: c.page.try_cast("int")
    good = F.filter(citations, lambda c: c.document_id.isNotNull() & c.chunk_id.isNotNull() & F.coalesce(page(c) > 0, F.lit(False)))
    return F.transform(good, lambda c: F.struct(c.document_id.alias("document_id"), page(c).alias("page"), c.chunk_id.alias("chunk_id")))


def sources(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, ord, document_id, title, pages): each answer's cited documents in the order of their first citation.

    citations: (answer_id, pos, document_id, page_number); documents: (document_id, title), one row each."""
    by_doc = citations.groupBy("answer_id", "document_id").agg(F.min("pos").alias("_first"), F.array_sort(F.collect_set("page_number")).alias("pages"))
    known = documents.select("document_id", F.coalesce("title", F.lit(UNTITLED)).alias("title"))
    rows = by_doc.join(known, "document_id", "left").withColumn("title", F.coalesce("title", F.lit(GONE)))
    return rows.withColumn("ord", F.expr("row_number() over (partition by answer_id order by _first, document_id)")).select("answer_id", "ord", "document_id", "title", "pages")


def source_lines(listed: DataFrame) -> DataFrame:
    """(answer_id, markdown): a line for each source, with its page or pages."""
    pages = F.concat(F.when(F.size("pages") == 1, "page ").otherwise("pages "), F.array_join(F.col("pages").cast("array<string>"), ", "))
    line = F.concat(F.lit("- "), "title", F.lit(" ("), pages, F.lit(")"))
    rows = listed.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("_l"))
    return rows.select("answer_id", F.array_join(F.col("_l.line"), "\n").alias("markdown"))


def event_rows(answers: DataFrame) -> DataFrame:
    """(query_id, seq, event, data): what a client is sent of each answer (query_id, answer, outcome): meta, a token for each
    word, final and done, in this order."""
    words = F.filter(F.split("answer", r"(?<=\s)"), lambda w: w != "")
    one = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    rows = F.concat(F.array(one("meta", F.col("outcome"))), F.transform(words, lambda w: one("token", w)), F.array(one("final", F.col("answer")), one("done", F.lit(""))))
    return answers.select("query_id", F.posexplode(rows).alias("seq", "_e")).select("query_id", "seq", "_e.event", "_e.data")
