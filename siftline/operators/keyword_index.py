"""Keyword search over a positional inverted index, ranked by cover density.

A chunk's lexemes are its words as they are, then, behind them, its words stemmed by its language without stopwords. The index
has a row for each chunk and lexeme with the sorted positions; it is dealt out by chunks, so that a word which every chunk has
is no hot key, and sorted by lexeme within a file, so that a scan for some lexemes skips the rest.

A query is one group of lexemes of which any matches, or several groups that must all match. A cover is a shortest stretch of
positions with a lexeme of every group; it weighs WEIGHT over one plus the positions in it that the query doesn't ask for, and
a chunk's rank is the sum over its covers. Ranks are added up in the task that holds the chunk, which sends on k rows for
each query.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions.columns import few
from siftline.operators.ranking import Leaders, top

# The weight of a position, the last position that is told apart, and how many of a lexeme are kept in a copy
# of the text and in all.
WEIGHT, LAST, IN_COPY, IN_ALL = 0.1, 16383, 255, 256
QUERIES = 5_000  # queries that a task ranks together
SLAB, CELLS = 1 << 20, 2_000_000  # bytes of chunks, and scores, that a task works on at once
NO_ID = -(1 << 63)  # what a null id is searched by
KNOWN = 500_000  # words of a configuration whose stems a task remembers
PAGE = 20_000  # rows of a page of the index, which a scan can skip
BY_NAME = 1_000  # lexemes that the scan looks up by name at most; more are joined

ENTRIES = "chunk_id long, lexeme string, positions array<int>"


def cleaned(text: Column) -> Column:
    """The words of a text (text.tokens) with single blanks between them."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


class Lexemes:
    """Ids of the lexemes that words stand for, plain and stemmed by a configuration; -1 for none. With `open`, a new lexeme gets
    an id. Each distinct word is stemmed once."""

    def __init__(self, ids: dict[str, int], stopwords: bool, open: bool = False) -> None:
        self.ids, self.open, self.known = ids, open, {}
        self.rules = {c: (re.compile(p), frozenset(X.STOPWORDS[c]) if stopwords else frozenset()) for c, p in X.ENDINGS.items()}

    def lookup(self, words: list[str], config: str | None) -> np.ndarray:
        if self.open:
            forms = words if config is None else [self.stem(w, config) for w in words]
            return np.array([-1 if w is None else self.ids.setdefault(w, len(self.ids)) for w in forms], np.int64)
        if config is None:
            return np.array([self.ids.get(w, -1) for w in words], np.int64)
        own = self.known.setdefault(config, {})
        if len(own) > KNOWN:
            own.clear()
        out = []
        for w in words:
            if (n := own.get(w)) is None:
                form = self.stem(w, config)
                n = own[w] = -1 if form is None else self.ids.get(form, -1)
            out.append(n)
        return np.array(out, np.int64)

    def stem(self, word: str, config: str) -> str | None:
        ending, stopwords = self.rules[config]
        return None if word in stopwords else ending.sub(r"\1", word)


def _tokens(texts: pa.Array, configs: list[str | None], local: np.ndarray, lexemes: Lexemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(local, copy, lexeme, position) of each word of cleaned texts that stands for a lexeme, plain and, if the text has a
    configuration, stemmed behind it."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    real = np.array([w != "" for w in words], bool)[code] if len(code) else np.zeros(0, bool)
    row, code = row[real], code[real]
    n = np.bincount(row, minlength=len(texts))
    place = np.minimum(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1, LAST)
    names = lexemes.lookup(words, None)[code] if len(code) else np.zeros(0, np.int64)
    out = [(row[names >= 0], 0, names[names >= 0], place[names >= 0])]
    for config in dict.fromkeys(c for c in configs if c is not None):
        of = np.flatnonzero(np.array([c == config for c in configs])[row]) if len(row) else np.zeros(0, np.int64)
        used, code_of = np.unique(code[of], return_inverse=True)
        names = lexemes.lookup([words[i] for i in used], config)[code_of] if len(of) else np.zeros(0, np.int64)
        of, names = of[names >= 0], names[names >= 0]
        out.append((row[of], 1, names, np.minimum(place[of] + np.minimum(n[row[of]], LAST), LAST)))
    rows, copies, names, places = zip(*out, strict=True)
    return local[np.concatenate(rows)], np.repeat(copies, [len(x) for x in rows]), np.concatenate(names), np.concatenate(places)


def _first(keys: np.ndarray, most: int) -> np.ndarray:
    """Of sorted distinct keys, the first `most` positions of each."""
    group = keys // (LAST + 1)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys)))) < most]


def _capped(local: np.ndarray, copy: np.ndarray, name: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Sorted keys (local * width + lexeme) * (LAST + 1) + position: distinct positions, as many as an index keeps."""
    kept = _first(np.unique(((local * width + name) * 2 + copy) * (LAST + 1) + place), IN_COPY)
    return _first(np.unique(kept // (2 * (LAST + 1)) * (LAST + 1) + kept % (LAST + 1)), IN_ALL)


def _slabs(batches: Iterable[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray], by: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by some columns, in batches of about `most` by their sizes; rows that are equal there stay together."""
    held: list[pa.RecordBatch] = []
    used = 0.0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in by:
            x = b.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
            new[0] |= bool(held) and held[-1].column(c)[-1].as_py() != x[0]
        total, begin = np.cumsum(size(b)), 0
        for i in np.flatnonzero(new):
            before = total[i - 1] - (total[begin - 1] if begin else 0) if i > begin else 0
            if used + before >= most:
                if i > begin:
                    held.append(b.slice(begin, i - begin))
                yield joined()
                held, used, begin = [], 0.0, i
        if b.num_rows > begin:
            held.append(b.slice(begin))
            used += total[-1] - (total[begin - 1] if begin else 0)
    if held:
        yield joined()


def _bytes(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False) + 8


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted ids: the distinct ones, and which of them each row has."""
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[new], np.cumsum(new) - 1


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRIES from (chunk_id, text, config), each row by itself."""
    for b in batches:
        sizes, begin = np.cumsum(_bytes(b)), 0
        while begin < b.num_rows:
            end = max(begin + 1, int(np.searchsorted(sizes, SLAB + (sizes[begin - 1] if begin else 0), "right")))
            part, ids = b.slice(begin, end - begin), {}
            local, copy, name, place = _tokens(part.column("text"), part.column("config").to_pylist(), np.arange(part.num_rows), Lexemes(ids, True, open=True))
            if width := len(ids):
                keys = _capped(local, copy, name, place, width)
                group, begins = np.unique(keys // (LAST + 1), return_index=True)
                lexemes = pa.array(list(ids), pa.string()).take(pa.array(group % width))
                positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(keys)).astype(np.int32)), pa.array((keys % (LAST + 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(group // width)), lexemes, positions], ["chunk_id", "lexeme", "positions"])
            begin = end


def texts_of(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text, config) of chunks (chunk_id, title, content, context, language): cleaned texts, and what they are stemmed
    by; null texts are empty, chunks without an id are left out."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(x), F.lit("")) for x in ("title", "content", "context")))
    return chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long"), cleaned(text).alias("text"), X.search_config(F.col("language")).alias("config"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, lexeme, positions) of chunks; see texts_of."""
    return texts_of(chunks).mapInArrow(_posted, ENTRIES)


def build(chunks: DataFrame, path: str, shards: int | None = None) -> None:
    """Writes the index under a path: a file for each shard of chunks, sorted by lexeme."""
    spark = chunks.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = postings(chunks).withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int"))
    rows.repartition(n, "shard").sortWithinPartitions("lexeme", "chunk_id").write.option("parquet.page.row.count.limit", PAGE).parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(path)


def any_of(queries: DataFrame) -> DataFrame:
    """(query_id, grp, lexeme) of queries (query_id, text): one group of the words of three letters or more, plain and stemmed by
    every configuration without its stopwords."""
    return queries.where("query_id is not null").select(F.col("query_id").cast("long"), F.lit(0).alias("grp"), F.explode(X.query_forms(F.col("text"))).alias("lexeme"))


def all_of(queries: DataFrame) -> DataFrame:
    """(query_id, grp, lexeme): a group for each distinct word, with its forms."""
    words = queries.where("query_id is not null").select(F.col("query_id").cast("long"), F.posexplode(F.array_distinct(F.filter(X.tokens(F.col("text")), lambda w: F.length(w) >= 3))).alias("grp", "word"))
    return words.select("query_id", "grp", F.explode(X.query_forms(F.col("word"))).alias("lexeme"))


def covers(at: np.ndarray, groups: np.ndarray, need: int) -> float:
    """The sum over covers. at: sorted distinct positions; groups: which groups each one matches, as bits; need: all groups."""
    total, start, n = 0.0, 0, len(at)
    while True:
        seen, end = 0, start
        while end < n:
            seen |= int(groups[end])
            if seen == need:
                break
            end += 1
        if end == n:
            return total
        seen, begin = 0, end
        while True:
            seen |= int(groups[begin])
            if seen == need:
                break
            begin -= 1
        count = end - begin + 1
        total += WEIGHT / (1 + int(at[end] - at[begin]) - (count - 1))
        start = begin + 1


class Asked:
    """The queries of a block as arrays: the groups of all queries side by side, and for each lexeme the groups that it is in."""

    def __init__(self, queries: list[int], groups: list[int], lexemes: list[str]) -> None:
        self.ids: dict[str, int] = {}
        name = np.array([self.ids.setdefault(w, len(self.ids)) for w in lexemes], np.int64)
        pairs, which = np.unique(np.stack([np.array(queries, np.int64), np.array(groups, np.int64)], 1), axis=0, return_inverse=True)
        self.queries, self.first, self.need = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        if self.need.max() > 63:
            raise ValueError("a query may have 63 groups at most")
        self.groups = len(pairs)
        both = np.unique(name * self.groups + which.ravel())
        self.group = both % self.groups
        self.begin = np.searchsorted(both, np.arange(len(self.ids) + 1) * self.groups)
        self.size = np.diff(self.begin)
        self.single, self.several = np.flatnonzero(self.need == 1), np.flatnonzero(self.need > 1)

    def met(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups that each of some lexemes is in: the lexeme's place among them, and the group."""
        size = self.size[names]
        place = np.repeat(np.arange(len(names)), size)
        return place, self.group[self.begin[names[place]] + np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)]


def _rank(asked: Asked, best: Leaders, ids: np.ndarray, local: np.ndarray, name: np.ndarray, n: np.ndarray, keys: np.ndarray | None) -> None:
    """Adds what chunks rank at to the best of each query. local, name, n: their postings, sorted by chunk, each with the number
    of its positions. keys: their sorted positions, see _capped; without them, all count, those of repeated words too.

    A position below LAST has one lexeme, so positions add up; LAST counts once. A chunk of several texts is the exception."""
    width = len(asked.ids)
    last, odd, begins = np.zeros(len(n), bool), np.zeros(len(ids), bool), None
    if keys is not None:
        begins = np.append(np.cumsum(n) - n, len(keys))
        last = keys[begins[1:] - 1] % (LAST + 1) == LAST
        at = np.sort(keys // (LAST + 1) // width * (LAST + 1) + keys % (LAST + 1))
        odd[at[1:][(at[1:] == at[:-1]) & (at[1:] % (LAST + 1) < LAST)] // (LAST + 1)] = True
    load = np.cumsum(np.bincount(local, weights=asked.size[name], minlength=len(ids)) + asked.groups)
    cuts = [0, *(np.flatnonzero(load[1:] // CELLS != load[:-1] // CELLS) + 1).tolist(), len(ids)]
    ends = np.searchsorted(local, cuts)
    for u, v, i, j in zip(cuts, cuts[1:], ends, ends[1:], strict=False):
        place, group = asked.met(name[i:j])
        cell, place = group * (v - u) + local[i:j][place] - u, place + i
        total = np.bincount(cell, weights=(n - last)[place], minlength=asked.groups * (v - u)).reshape(asked.groups, -1)
        if last.any():
            total.ravel()[np.unique(cell[last[place]])] += 1
        if len(asked.single):
            rows = total[asked.first[asked.single]]
            scores = np.where(rows > 0, np.round(rows * WEIGHT, 6), -np.inf)
            scores[:, odd[u:v]] = -np.inf
            best.add(asked.single, ids[u:v], scores)
        strange = np.flatnonzero(odd[u:v])
        pairs = [(asked.single[q], u + strange[c]) for q, c in zip(*np.nonzero(total[asked.first[asked.single]][:, strange] > 0), strict=True)]
        if len(asked.several):
            every = np.logical_and.reduceat(total > 0, asked.first, axis=0)[asked.several]
            pairs += [(asked.several[q], u + c) for q, c in zip(*np.nonzero(every), strict=True)]
        if pairs:
            scores = [_covered(asked, q, name, keys, begins, *np.searchsorted(local, [c, c + 1])) for q, c in pairs]
            best.put(np.array([q for q, _ in pairs]), ids[[c for _, c in pairs]], np.round(scores, 6))


def _covered(asked: Asked, query: int, name: np.ndarray, keys: np.ndarray, begins: np.ndarray, i: int, j: int) -> float:
    """What one chunk, postings i to j, ranks at for one query."""
    place, group = asked.met(name[i:j])
    own = (group >= asked.first[query]) & (group < asked.first[query] + asked.need[query])
    place, bit = place[own] + i, np.left_shift(np.int64(1), group[own] - asked.first[query])
    size = begins[place + 1] - begins[place]
    at = keys[np.repeat(begins[place], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] % (LAST + 1)
    order = np.argsort(at, kind="stable")
    at, bits = at[order], np.repeat(bit, size)[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return len(first) * WEIGHT if asked.need[query] == 1 else covers(at[first], np.bitwise_or.reduceat(bits, first), (1 << int(asked.need[query])) - 1)


def _searched(batches: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (part, block, side, id, text, grp, config, positions) come sorted: a block's queries, of which text is a lexeme, then a part
    of the chunks. The k best chunks of each query. kind: "entry" if text is a lexeme of the index; else text is a cleaned
    text, which ranks by "cover" density or by all words "counted"."""
    at: tuple | None = None
    rows: list[pa.RecordBatch] = []
    asked = best = lexemes = None

    def size(b: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(b.column("positions")), 0).to_numpy(zero_copy_only=False) * 8 + 8 if kind == "entry" else _bytes(b)

    for b in _slabs(batches, size, ("part", "block", "side", "id"), SLAB):
        part, block, side = (b.column(c).to_numpy() for c in ("part", "block", "side"))
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
            if (part[i], block[i]) != at:
                if best is not None:
                    yield best.rows(asked.queries).rename_columns(["query_id", "chunk_id", "rank"])
                at, rows, asked, best = (part[i], block[i]), [], None, None
            own = b.slice(i, j - i)
            if side[i] == 0:
                rows.append(own)
                continue
            if asked is None:
                if not rows:
                    continue
                asked = Asked(*(sum((r.column(c).to_pylist() for r in rows), []) for c in ("id", "grp", "text")))
                best, lexemes = Leaders(len(asked.queries), k), Lexemes(asked.ids, kind == "cover")
            ids, local = _numbered(own.column("id").to_numpy())
            width = len(asked.ids)
            keys = None
            if kind == "entry":
                coded = own.column("text").dictionary_encode()
                name = np.array([asked.ids.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                places = own.column("positions")
                n = pc.list_value_length(places).to_numpy()
                keys = np.repeat(np.where(name < 0, -1, local * width + name), n) * (LAST + 1) + places.flatten().to_numpy()
                keys = np.unique(keys[keys >= 0])
            else:
                found = _tokens(own.column("text"), own.column("config").to_pylist(), local, lexemes)
                if kind == "cover":
                    keys = _capped(*found, width)
            pairs, n = np.unique(found[0] * width + found[2] if keys is None else keys // (LAST + 1), return_counts=True)
            if len(pairs):
                _rank(asked, best, ids, pairs // width, pairs % width, n, keys)
    if best is not None:
        yield best.rows(asked.queries).rename_columns(["query_id", "chunk_id", "rank"])


def _search(asked: DataFrame, rows: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, chunk_id, rank, ord): blocks of QUERIES queries (query_id, grp, lexeme) meet each part of the rows (id, text, config,
    positions) of chunks, dealt out by id. A task keeps k rows for each of its queries and holds SLAB bytes of the chunks."""
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = -(-max(1, asked.select("query_id").distinct().count()) // QUERIES)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.distinct().withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    left = left.select("part", "block", F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("lexeme").alias("text"), "grp", F.lit(None).cast("string").alias("config"), F.array().cast("array<int>").alias("positions"))
    right = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    right = right.select("part", "block", F.lit(1).alias("side"), "id", "text", F.lit(0).alias("grp"), "config", "positions")
    work = left.unionByName(right).repartition(parts, "part", "block").sortWithinPartitions("part", "block", "side", "id")
    found = work.mapInArrow(partial(_searched, k=k, kind=kind), "query_id long, chunk_id long, rank double")
    return top(found, k, [F.desc("rank"), F.col("chunk_id")])


def cover_topk(asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank, ord): the k best chunks of each query by cover density, ties by chunk. asked: (query_id, grp,
    lexeme), see any_of and all_of; entries: (chunk_id, lexeme, positions), the index or a part of it.

    The postings of the lexemes asked for are dealt out by chunks, and blocks of QUERIES queries meet each part of them, so no
    lexeme gathers in one task and neither side passes through the driver."""
    names = asked.select("lexeme").distinct()
    some = [r.lexeme for r in names.limit(BY_NAME + 1).collect()]
    if len(some) <= BY_NAME:  # few lexemes reach the scan, which skips pages by them
        hits = entries.where(F.col("lexeme").isin(some))
    else:
        hits = entries.join(few(names, F.length("lexeme") + 40), "lexeme", "left_semi")
    return _search(asked, hits.select(F.col("chunk_id").alias("id"), F.col("lexeme").alias("text"), F.lit(None).cast("string").alias("config"), "positions"), k, "entry")


def counted_topk(wanted: DataFrame, texts: DataFrame, k: int, stemmed: bool) -> DataFrame:
    """(query_id, chunk_id, rank, ord): WEIGHT for each word of a text (chunk_id, text, config) that is a token which the query
    (query_id, token) wants, and, if stemmed, for each whose stem by its configuration is one. A null id is an id like others."""
    known, given = (lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID))), (lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c))
    asked = wanted.select(known("query_id").alias("query_id"), F.lit(0).alias("grp"), F.col("token").alias("lexeme"))
    config = F.col("config") if stemmed else F.lit(None).cast("string")
    rows = texts.where("text is not null").select(known("chunk_id").alias("id"), "text", config.alias("config"), F.lit(None).cast("array<int>").alias("positions"))
    return _search(asked, rows, k, "counted").select(given("query_id"), given("chunk_id"), "rank", "ord")


def keyword_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """cover_topk of queries (query_id, text) over chunks that have no index yet: a text's postings of the lexemes asked for are
    made and ranked in the task that holds it."""
    texts = texts_of(chunks).select(F.col("chunk_id").alias("id"), "text", "config", F.lit(None).cast("array<int>").alias("positions"))
    return _search(any_of(queries), texts, k, "cover")
