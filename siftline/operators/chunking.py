"""Cutting documents into sections and chunks.

Sectioning and packing carry a state from line to line, so they are one pass over each document's sorted rows in Python; all
else is column expressions. Token counts come from a counter that the caller may give (default: words).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.sources.shared import kept

# What a heading, a list item and a table row look like, and the least length of a chunk that stands alone.
NUMBERED = r"(?:\d+(?:\.\d+)*\s+)?"
CAPITALS = NUMBERED + r"[A-ZÄÖÜ0-9][A-ZÄÖÜ0-9\s:/-]{3,}"
TITLE = NUMBERED + r"[A-ZÀ-Ü][a-zà-ÿ]+(?:\s+(?:[A-ZÀ-Ü][a-zà-ÿ]+|and|or|of|the|for|in|on|to|with|&|/|-)){1,10}"
ITEM = r"(?:[-*•]\s+|\d+(?:[.)]\s+))"
RELAXED = 20
_CAPITALS, _TITLE, _ITEM, _ENDS = re.compile(CAPITALS), re.compile(TITLE), re.compile(ITEM), re.compile(r"[.!?]$")
_RULE = re.compile(r"\|(?:\s*-{3,}\s*\|)+")
SECTION = "doc_id long, page int, section int, title string, text string"
CHUNK = "doc_id long, chunk_index int, page int, title string, content string, language string, n_tokens int"


def fixed_windows(docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """(doc_id, chunk_index, n_words, content): windows of words, each `overlap` words into the one before."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    n, step = F.size("words"), size - overlap
    begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1))
    rows = docs.select("doc_id", words.alias("words")).where(n > 0).select("doc_id", "words", F.explode(begins).alias("chunk_index"))
    part = F.slice("words", F.col("chunk_index") * step + 1, size)
    return rows.select("doc_id", "chunk_index", F.size(part).alias("n_words"), F.array_join(part, " ").alias("content"))


def is_row(line: str) -> bool:
    """A row of a table in pipes."""
    x = line.strip()
    return len(x) > 1 and x[0] == x[-1] == "|"


def heading(line: str) -> int:
    """The depth of a heading line, or 0: the number's parts if it has one, else 1 in capitals and 2 in title case."""
    x = line.strip()
    if not x or len(x) > 120 or is_row(x):
        return 0
    upper = _CAPITALS.fullmatch(x) and re.search("[A-ZÄÖÜ]", x)
    if not upper and not _TITLE.fullmatch(x):
        return 0
    number = re.match(r"(\d+(?:\.\d+)*)\s+", x)
    return number[1].count(".") + 1 if number else 1 if upper else 2


def heading_depth(line: Column) -> Column:
    """The same as a column expression."""
    x = F.trim(line)
    upper = x.rlike(f"^{CAPITALS}$") & x.rlike("[A-ZÄÖÜ]")
    number = F.regexp_extract(x, r"^(\d+(?:\.\d+)*)\s+", 1)
    depth = F.when(number != "", F.size(F.split(number, r"\."))).when(upper, 1).otherwise(2)
    return F.when((x != "") & (F.length(x) <= 120) & ~x.rlike(r"^\|.*\|$") & (upper | x.rlike(f"^{TITLE}$")), depth).otherwise(0)


def cut_page(page: int, text: str, path: list[str]) -> Iterator[tuple[str, str]]:
    """(title, text) of a page's sections; path, the headings above, is carried on."""
    if not text.strip():
        return
    where = lambda: " / ".join(path) or f"Page {page}"
    title, body, found = where(), [], False
    for line in [*map(str.strip, re.split(r"\r?\n", text)), None]:
        depth = heading(line) if line else 0
        if (line is None or depth) and body:
            yield title, re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip()
            body, found = [], True
        if depth:
            path[depth - 1 :] = [line]
            title = where()
        if line or (line == "" and body and body[-1] != ""):
            body.append(line)
    if not found:
        yield where(), text.strip()


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page, section, title, text): pages (doc_id, page, text) cut at headings, which stay in the body; the path of
    headings runs on over pages. One pass over each document's sorted pages. Null or blank pages have no section."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, path, n = None, [], 0
        for b in batches:
            out = []
            for d, page, text in zip(b["doc_id"], b["page"], b["text"], strict=True):
                if d != doc:
                    doc, path, n = d, [], 0
                for title, body in cut_page(page, text or "", path):
                    out.append((d, page, n, title, body))
                    n += 1
            yield pd.DataFrame(out, columns=["doc_id", "page", "section", "title", "text"])

    rows = pages.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInPandas(run, SECTION)


def section_languages(rows: DataFrame, hint: Column | None = None) -> DataFrame:
    """Adds language to sections (doc_id, section, text): the hint if there is one; a section's own where detection is sure of
    it; else the one that most of the document's sure sections have (the first seen if equal), EN without any. Sections and what
    is detected in them are written once, since both the votes and the result read them."""
    found = kept(rows.withColumn("_x", X.detect_language(F.col("text"))), "detected")
    sure = F.col("_x.confident")
    votes = found.where(sure).groupBy("doc_id", "_x.language").agg(F.count("*").alias("_n"), F.min("section").alias("_f"))
    most = votes.groupBy("doc_id").agg(F.max_by("language", F.struct("_n", -F.col("_f"))).alias("_most"))
    own = F.when(sure, F.col("_x.language")).otherwise(F.coalesce("_most", F.lit("EN")))
    out = found.join(most, "doc_id", "left").withColumn("language", own if hint is None else F.coalesce(hint, own))
    return out.drop("_x", "_most")


def mode_language(rows: DataFrame, fallback: Column | None = None) -> DataFrame:
    """(doc_id, language): the language that most of a document's chunks (doc_id, chunk_index, language) have, the first seen if
    equal, unless the fallback is given."""
    votes = rows.groupBy("doc_id", "language").agg(F.count("*").alias("_n"), F.min("chunk_index").alias("_f"))
    most = votes.groupBy("doc_id").agg(F.max_by("language", F.struct("_n", -F.col("_f"))).alias("_most"))
    return most.select("doc_id", F.coalesce(fallback if fallback is not None else F.lit(None), "_most", F.lit("EN")).alias("language"))


def words(text: str) -> int:
    return len(text.split())


def paragraphs(text: str) -> list[str]:
    """Paragraphs between blank lines with single spaces; each list item by itself; a run of table rows as it is."""
    out: list[str] = []
    kind = None  # of the paragraph that the next line may go on with
    for line in map(str.strip, re.split(r"\r?\n", text)):
        now = None if not line else "table" if is_row(line) else "item" if _ITEM.match(line) else "prose"
        if now in ("table", "prose") and now == kind:
            out[-1] += ("\n" if now == "table" else " ") + line
        elif now:
            out.append(line)
        kind = now
    return [x if is_row(x.split("\n")[0]) else " ".join(x.split()) for x in out]


@dataclass
class Packer:
    """Packs sections into chunks of about `target` tokens, each beginning with the paragraphs that end the one before, as many
    as hold `overlap` tokens."""

    target: int = 700
    overlap: int = 120
    least: int = 120
    count: Callable[[str], int] = words
    known: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.target <= 0 or not 0 <= self.overlap < self.target:
            raise ValueError("the target must be positive and the overlap below it")

    def size(self, text: str) -> int:
        if (n := self.known.get(text)) is None:
            if len(self.known) > 20_000:
                self.known.clear()
            n = self.known[text] = self.count(text)
        return n

    def merged(self, rows: list[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
        """(page, title, text): neighbours at most a page apart of which one is too small become one, if they fit."""
        least, held = max(RELAXED, self.least), None
        for page, title, text in rows:
            if held is not None:
                both = f"{held[2]}\n\n{text}".strip()
                small = min(len(held[2].strip()), len(text.strip())) < least
                if small and abs(page - held[0]) <= 1 and self.size(both) <= int(self.target * 1.15):
                    titles = held[1] + [title] * (title not in held[1])
                    held = (held[0], titles, both)
                    continue
                yield held[0], " / ".join(held[1]), held[2]
            held = (page, [title], text)
        if held is not None:
            yield held[0], " / ".join(held[1]), held[2]

    def rows_of(self, table: str) -> list[str]:
        """A table cut between rows, its head on every piece."""
        lines = table.split("\n")
        head = lines[: 2 if len(lines) > 1 and _RULE.fullmatch(lines[1].strip()) else 1]
        body, pieces = lines[len(head) :], []
        start = used = self.size("\n".join(head))
        for line in body:
            n = self.size(line)
            if not pieces or (pieces[-1] and used + n > self.target):
                pieces.append([])
                used = start
            pieces[-1].append(line)
            used += n
        return ["\n".join([*head, *x]) for x in pieces] or [table]

    def windows_of(self, paragraph: str) -> list[str]:
        """A paragraph cut into windows of words, preferably where a sentence ends near the window's end."""
        w = paragraph.split()
        rate = len(w) / max(1, self.size(paragraph))
        width, back = max(1, int(self.target * rate)), max(0, int(self.overlap * rate))
        out, at = [], 0
        while at < len(w):
            end = min(at + width, len(w))
            if end < len(w):
                near = [i for i in range(max(1, end - 50), min(len(w), end + 50)) if _ENDS.search(w[i - 1])]
                end = min(near, key=lambda i: (abs(i - end), i), default=end)
            if piece := " ".join(w[at:end]):
                out.append(piece)
            if end >= len(w):
                break
            at = max(end - back, at + 1)
        return out

    def tail(self, parts: list[str]) -> list[str]:
        """The last paragraphs that hold the overlap."""
        n = 0
        for i in range(len(parts) - 1, -1, -1) if self.overlap else ():
            n += self.size(parts[i])
            if n >= self.overlap:
                return parts[i:]
        return parts if self.overlap else []

    def section(self, text: str) -> Iterator[str]:
        """The chunks of one section; a short one stays whole."""
        plain = " ".join(text.split())
        if not plain:
            return
        held, fresh, emitted = [], 0, False  # paragraphs of the chunk to come, and how many of them no chunk has had

        for p in [*paragraphs(text), None]:
            n = self.size(p) if p is not None else self.target + 1
            used = sum(map(self.size, held))
            if held and used and used + n > self.target:
                if not fresh:
                    held = []
                else:
                    whole = "\n\n".join(held).strip()
                    if len(whole) >= self.least:
                        yield whole
                        emitted, held = True, self.tail(held)
                    else:
                        held = []
                    fresh = 0
                    if p is not None and n <= self.target and sum(map(self.size, held)) + n > self.target:
                        held = []
            if p is None:
                break
            if n > self.target:
                for piece in self.rows_of(p) if is_row(p.split("\n")[0]) else self.windows_of(p):
                    if len(piece) >= min(self.least, RELAXED):
                        yield piece
                        emitted = True
                held, fresh = [], 0
            else:
                held.append(p)
                fresh += 1
        if not emitted and len(plain) >= min(self.least, RELAXED):
            yield text.strip() if any(map(is_row, text.split("\n"))) else plain


def pack_sections(rows: DataFrame, packer: Packer | None = None) -> DataFrame:
    """(doc_id, chunk_index, page, title, content, language, n_tokens): chunks of sections (doc_id, section, page, title, text,
    language), packed within runs of one language, numbered through the document. A document whose sections give no chunk is
    one chunk, titled Document."""
    packer = packer or Packer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, group, out, n, texts = None, [], [], 0, []

        def close_group() -> None:
            nonlocal group, n
            for page, title, text in packer.merged([x[:3] for x in group]):
                for content in packer.section(text):
                    out.append((doc, n, page, title, content, group[0][3], packer.size(content)))
                    n += 1
            group = []

        def close_doc() -> None:
            close_group()
            whole = " ".join(" ".join(x[2] for x in texts).split())
            if doc is not None and n == 0 and whole:
                out.append((doc, 0, texts[0][0], "Document", whole, texts[0][3], packer.size(whole)))

        for b in batches:
            for d, page, title, text, language in zip(b["doc_id"], b["page"], b["title"], b["text"], b["language"], strict=True):
                if d != doc:
                    close_doc()
                    doc, n, texts = d, 0, []
                elif group and group[0][3] != language:
                    close_group()
                group.append((page, title, text or "", language))
                texts = texts if n else [*texts, group[-1]]
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])
                out = []
        close_doc()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in CHUNK.split(", ")])

    picked = rows.select("doc_id", "section", "page", "title", "text", "language")
    return picked.repartition("doc_id").sortWithinPartitions("doc_id", "section").mapInPandas(run, CHUNK)


def chunk_documents(pages: DataFrame, hint: Column | None = None, packer: Packer | None = None) -> DataFrame:
    """Pages (doc_id, page, text) to chunks: sections, their languages, packing."""
    return pack_sections(section_languages(sections(pages), hint), packer)


def reindex(rows: DataFrame) -> DataFrame:
    """chunk_index anew from 0 without gaps, by (run, chunk_index) of each document."""
    w = Window.partitionBy("doc_id").orderBy("run", "chunk_index")
    return rows.withColumn("_i", F.row_number().over(w) - 1).drop("chunk_index").withColumnRenamed("_i", "chunk_index")


def embed_input(title: Column, section: Column, context: Column, content: Column) -> Column:
    """What is embedded of a chunk; missing parts are empty."""
    return F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in (title, section, context)), F.lit(""), F.coalesce(content, F.lit("")))


def language_runs(rows: DataFrame) -> DataFrame:
    """Consecutive rows (doc_id, ord, language) of one language: doc_id, run, language, first, last, n."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    change = F.coalesce((F.col("language") != F.lag("language").over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.first("language").alias("language"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n"))


def backfill_languages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, old, new, reason): chunks (chunk_id, document_id, ord, title, content, language) whose language changes when
    detected anew; one that detection isn't sure of takes its document's (document_id, language), else the one that most
    of the document's sure chunks have."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    found = kept(chunks.select("chunk_id", "document_id", "ord", "language", X.detect_language(text).alias("_x")), "detected")
    votes = found.where("_x.confident").groupBy("document_id", "_x.language").agg(F.count("*").alias("_n"), F.min("ord").alias("_f"))
    most = votes.groupBy("document_id").agg(F.max_by("language", F.struct("_n", -F.col("_f"))).alias("_most"))
    j = found.join(documents.select("document_id", F.col("language").alias("_doc")), "document_id").join(most, "document_id", "left")
    new = F.when(F.col("_x.confident"), F.col("_x.language")).otherwise(F.coalesce("_doc", "_most", F.lit("EN")))
    rows = j.withColumn("new", new).where(~F.col("new").eqNullSafe(F.col("language")))
    return rows.select("chunk_id", F.col("language").alias("old"), "new", F.when(F.col("_x.confident"), "detected").otherwise("inherited").alias("reason"))
