"""Ranked lists as DataFrames: every list has (query_id, ord), ord made by an explicit total order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import text as X
from siftline.functions import vector as V
from siftline.functions.columns import few

QUERIES, CHUNKS = 50_000, 500_000  # query and chunk vectors that a task of the vector search joins
SUB = 1024  # queries, and chunks, that are multiplied at once


def ranked(df: DataFrame, order: list[Column], name: str = "ord", by: str = "query_id") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first k of each list; the rank filter is pushed below the shuffle."""
    return ranked(df, order, by=by).where(F.col("ord") <= k)


def _unit(rows: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Vectors at length 1 in double precision; a zero vector stays zero."""
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    norms = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


class Leaders:
    """The k best chunks of each of n queries, by score, ties by id. Memory is bounded by n * k and by what is added at once."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.ids, self.scores = k, np.zeros((n, k), np.int64), np.full((n, k), -np.inf)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """A row of scores for each of the queries in which, a column for each id; -inf is no match."""
        floor, m = self.scores[which, -1], scores.shape[1]
        if m > self.k:
            floor = np.maximum(floor, np.partition(scores, m - self.k, axis=1)[:, m - self.k])
        q, c = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        self.put(which[q], ids[c], scores[q, c])

    def put(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Single candidates: query, id and score."""
        touched = np.unique(q)
        if not len(touched):
            return
        q = np.concatenate([np.repeat(touched, self.k), q])
        ids, scores = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.repeat(np.searchsorted(q, touched), np.bincount(np.searchsorted(touched, q)))
        kept = place < self.k
        self.ids[q[kept], place[kept]], self.scores[q[kept], place[kept]] = ids[kept], scores[kept]

    def rows(self, queries: np.ndarray) -> pa.RecordBatch:
        found = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, self.k)[found.ravel()]), pa.array(self.ids[found]), pa.array(self.scores[found])], ["query_id", "chunk_id", "score"])


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (part, block, side, id, embedding) come sorted: a task's queries, then its chunks, of which it keeps the best
        k for each query."""
        at, queries, vectors, best = None, [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            if best is not None:
                yield best.rows(np.concatenate(queries)).rename_columns(["query_id", "chunk_id", "similarity"])

        for b in batches:
            part, block, side = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if i == j:
                    continue
                if (part[i], block[i]) != at:
                    yield from out()
                    at, queries, vectors, best = (part[i], block[i]), [], [], None
                names, x = b.column(3).to_numpy()[i:j], _unit(b.column(4).slice(i, j - i), j - i)
                if side[i] == 0:
                    queries.append(names)
                    vectors.append(x)
                elif queries:
                    if len(vectors) > 1:
                        queries, vectors = [np.concatenate(queries)], [np.concatenate(vectors)]
                    best = best or Leaders(len(vectors[0]), k)
                    for q in range(0, len(vectors[0]), SUB):
                        for c in range(0, len(x), SUB):
                            best.add(np.arange(q, min(q + SUB, len(vectors[0]))), names[c : c + SUB], np.round(vectors[0][q : q + SUB] @ x[c : c + SUB].T, 6))
        yield from out()

    return run


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, similarity, ord): exact cosine top-k of queries (query_id, embedding) over chunks (chunk_id,
    embedding). A block nested loop: queries and chunks are cut into parts of a bounded size, each pair of parts is a task that
    keeps k rows for each of its queries. Nothing passes through the driver. Vectors meet those of their own length; rows
    without an id, and null, empty or unsound vectors, are left out."""
    side = lambda df, name: df.where(F.col(name).isNotNull() & V.sound(F.col("embedding"))).select(F.col(name).cast("long").alias("id"), "embedding")
    q, c = side(queries, "query_id"), side(chunks, "chunk_id")
    width = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks, parts = -(-max(1, q.count()) // QUERIES), max(-(-c.count() // CHUNKS), min(width, 64))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.withColumn("block", mine(blocks)).withColumn("part", each(parts)).withColumn("side", F.lit(0))
    right = c.withColumn("part", mine(parts)).withColumn("block", each(blocks)).withColumn("side", F.lit(1))
    work = left.unionByName(right).select((F.size("embedding").cast("long") * (1 << 32) + F.col("part")).alias("part"), "block", "side", "id", "embedding")
    found = work.repartition("part", "block").sortWithinPartitions("part", "block", "side").mapInArrow(_nearest(k), "query_id long, chunk_id long, similarity double")
    return top(found, k, [F.desc("similarity"), F.col("chunk_id")])


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank, ord): 0.1 for each position of a chunk (chunk_id, text) whose token the query (query_id,
    text) has; query tokens of three characters or more, however many. Only tokens that some query has are counted."""
    from siftline.operators import keyword_index as N  # which imports this module

    wanted = queries.select("query_id", F.explode(F.array_distinct(F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= 3))).alias("token"))
    return N.counted_topk(wanted, chunks.select("chunk_id", N.cleaned(F.col("text")).alias("text")), k, stemmed=False)


def lexical_overlaps(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, overlap): text.lexical_overlap of each query (item_id, text) that has tokens with each of docs (doc_id,
    text). Which tokens a word meets is found once for each distinct word, so that a pair compares only what its text met."""
    q = queries.select("item_id", X.query_tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    docs = docs.select("doc_id", F.sha2("text", 256).alias("_key"), F.array_distinct(X.tokens(F.col("text"))).alias("_w"))
    words = docs.select("_key", F.explode("_w").alias("_y")).distinct()
    asked = q.select(F.explode("q").alias("_t")).distinct()
    long = asked.where(F.length("_t") >= 5)
    begins = long.select("_t", F.explode(F.transform(F.sequence(F.lit(1), F.length("_t")), lambda n: F.left(F.col("_t"), n))).alias("_y"))
    same = begins.unionByName(asked.where(F.length("_t") < 5).select("_t", F.col("_t").alias("_y")))
    each = words.select("_y").distinct()
    goes_on = each.withColumn("_five", F.left("_y", F.lit(5))).join(long.withColumn("_five", F.left("_t", F.lit(5))), "_five").where(F.col("_y").startswith(F.col("_t"))).select("_t", "_y")
    met = each.join(same, "_y").select("_t", "_y").unionByName(goes_on).distinct()
    hits = words.join(met, "_y").select("_key", "_t").distinct()
    n = hits.join(q.select("q").distinct().select("q", F.explode("q").alias("_t")), "_t").groupBy("_key", "q").agg(F.count("*").alias("_n"))
    per = few(q, 40 + F.length(F.array_join("q", "        ")))
    return docs.select("doc_id", "_key").join(per, how="cross").join(n, ["_key", "q"], "left").select("item_id", "doc_id", (F.coalesce("_n", F.lit(0)) / F.size("q")).alias("overlap"))


def scoped(chunks: DataFrame, documents: DataFrame | None = None, ids: list | DataFrame | None = None, language: str | None = None) -> DataFrame:
    """Chunks that a search may see: of ready documents (document_id, status), of the named ids (a short list, or rows of
    document_id), of a language; what isn't given doesn't restrict."""
    if documents is not None:
        chunks = chunks.join(documents.where("status = 'ready'").select("document_id"), "document_id", "left_semi")
    if isinstance(ids, DataFrame):
        chunks = chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    elif ids:
        chunks = chunks.where(F.col("document_id").isin(ids))
    return chunks.where(F.col("language") == language) if language else chunks


def lexeme_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank, ord) over chunks (chunk_id, title, content, context, language): 0.1 for each position of a
    lexeme that the query (query_id, text) has. Chunks have their words plain and stemmed by their language, queries theirs
    plain and stemmed by every language."""
    from siftline.operators import keyword_index as N  # which imports this module

    wanted = queries.select("query_id", F.explode(X.query_lexemes(F.col("text"))).alias("token"))
    text = F.concat_ws(" ", *(F.coalesce(F.col(x), F.lit("")) for x in ("title", "content", "context")))
    return N.counted_topk(wanted, chunks.select("chunk_id", N.cleaned(text).alias("text"), X.search_config(F.col("language")).alias("config")), k, stemmed=True)


def rrf(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, chunk_id, ord): score, source, and both ranks; a similarity in the vector
    list is kept."""
    v = vector.select("query_id", "chunk_id", F.col("ord").alias("vector_rank"), *(["similarity"] if "similarity" in vector.columns else []))
    w = keyword.select("query_id", "chunk_id", F.col("ord").alias("keyword_rank"))
    part = lambda c: F.coalesce(1.0 / (max(1, k) + F.col(c)), F.lit(0.0))
    both = v.join(w, ["query_id", "chunk_id"], "full_outer")
    both = both.withColumn("score", F.round(part("vector_rank") + part("keyword_rank"), 9))
    source = F.when(F.col("vector_rank").isNotNull() & F.col("keyword_rank").isNotNull(), "hybrid").when(F.col("vector_rank").isNotNull(), "vector").otherwise("keyword")
    return ranked(both.withColumn("source", source), [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"), F.col("chunk_id")])


def weighted_fusion(branches: DataFrame, k: int = 60) -> DataFrame:
    """Fusion of branch lists (query_id, chunk_id, branch, weight, ord): the sum of weight / (k + rank), ties by first sight."""
    first = F.min(F.struct("branch", "ord"))
    fused = branches.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("ord"))), 9).alias("score"), first.alias("_first"), F.max("branch").alias("kept_branch"))
    return ranked(fused, [F.desc("score"), F.col("_first"), F.col("chunk_id")]).drop("_first")


def pool_merge(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row of each (query_id, key), the one with the best relevance (the earlier by ord if equal), and a new ord by that
    relevance, then first sight."""
    rest = [c for c in rows.columns if c not in ("query_id", key)]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("relevance", F.lit(float("-inf"))), -F.col("ord")))
    merged = rows.groupBy("query_id", key).agg(best.alias("_b"), F.min("ord").alias("_first")).select("query_id", key, "_b.*", "_first")
    return ranked(merged.drop("ord"), [F.desc("relevance"), F.col("_first"), F.col(key)]).drop("_first")


def variation_merge(lists: DataFrame) -> DataFrame:
    """Vector results (query_id, variation, ord, chunk_id, score) of a query's variations as one list: the best score of each
    chunk, ties by first sight (variation, ord)."""
    g = lists.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min(F.struct("variation", "ord")).alias("_first"))
    return ranked(g, [F.desc("score"), F.col("_first"), F.col("chunk_id")]).drop("_first")


def candidate_limit(top_k: int, pool: int, least: int = 20) -> int:
    """How many candidates each search fetches."""
    return max(4 * top_k, pool, least)


def heuristic_rerank(pool: DataFrame, size: int | None = None) -> DataFrame:
    """Adds rerank_score and relevance to the first `size` rows of each pool (query_id, chunk_id, score, similarity, lexical,
    exact, same_language, ord); the others leave. A pool whose best score is 0 counts as even."""
    pool = pool.where(F.col("ord") <= max(1, size)) if size is not None else pool
    best = F.max("score").over(Window.partitionBy("query_id"))
    vec = F.coalesce(F.col("similarity"), 0.6 * F.col("lexical"))
    clamp = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 9)
    order = 0.55 * F.when(best > 0, F.col("score") / best).otherwise(1.0) + 0.30 * F.col("lexical") + 0.10 * vec + 0.05 * F.col("exact") + 0.04 * F.col("same_language")
    out = pool.withColumns({"rerank_score": clamp(order), "relevance": clamp(0.65 * vec + 0.30 * F.col("lexical") + 0.05 * F.col("exact"))})
    return ranked(out.withColumnRenamed("ord", "_in"), [F.desc("rerank_score"), F.desc("score"), F.col("_in")]).drop("_in")


def text_features(pool: DataFrame) -> DataFrame:
    """Adds lexical, exact and same_language to rows (query, query_language, title, context, content, language)."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("content", F.lit(""))))
    overlap = X.lexical_overlap(X.query_tokens(F.col("query")), F.array_distinct(X.tokens(text)))
    return pool.withColumns({"lexical": overlap, "exact": F.contains(text, F.col("query")).cast("int"), "same_language": F.coalesce((F.col("language") == F.col("query_language")).cast("int"), F.lit(0))})


def encoder_text(title: Column, context: Column, content: Column, with_context: bool, most: int = 4096, head: int = 1024) -> Column:
    """What a cross-encoder reads of a chunk: title and content, or a bounded header of title and context with as much content
    as the rest of the bound holds."""
    plain = F.left(F.concat(title, F.lit("\n"), content), F.lit(most))
    if not with_context:
        return plain
    header = F.left(F.concat(title, F.lit("\n"), context), F.lit(head))
    full = F.concat(header, F.lit("\n"), F.left(content, F.lit(most) - F.length(header) - 1))
    return F.when(F.coalesce(context, F.lit("")) == "", plain).otherwise(full)


def cross_encoder(rows: DataFrame, scores: DataFrame | Column, cap: int = 100) -> DataFrame:
    """rows (query_id, chunk_id, ord, ...) in the order of a provider's scores, a column or rows (query_id, chunk_id, score): the
    first `cap` by score, the others behind them as they were. A query for which any of the capped rows lacks a score keeps
    its order."""
    q = Window.partitionBy("query_id")
    if isinstance(scores, Column):
        got = rows.withColumn("_s", F.when(F.col("ord") <= cap, scores))
    else:
        got = rows.join(scores.select("query_id", "chunk_id", F.col("score").alias("_s")), ["query_id", "chunk_id"], "left")
    in_cap = F.col("ord") <= cap
    got = got.withColumn("_all", F.min((F.col("_s").isNotNull() | ~in_cap).cast("int")).over(q) == 1)
    got = got.withColumn("_new", in_cap & F.col("_all"))
    new = F.col("_new")
    put = lambda c, v: F.when(new, v).otherwise(F.col(c) if c in rows.columns else F.lit(None))
    got = got.withColumns({"rerank_score": put("rerank_score", F.col("_s")), "relevance": put("relevance", F.col("_s")), "scale": put("scale", F.lit("cross_encoder"))})
    order = [F.when(new, 0).otherwise(1), F.when(new, -F.col("_s")), F.col("_in")]
    return ranked(got.withColumnRenamed("ord", "_in"), order).drop("_in", "_s", "_all", "_new")


def adjacency_boost(rows: DataFrame, boost: float = 0.05) -> DataFrame:
    """Adds the boost once for each neighbour in (query_id, document_id) by page that is at most one page away, and orders by
    the boosted score; ties by the document's first appearance, page and former place."""
    doc = Window.partitionBy("query_id", "document_id")
    w = doc.orderBy("page", "ord")
    near = lambda gap: F.coalesce((gap <= 1).cast("int"), F.lit(0))
    n = near(F.col("page") - F.lag("page").over(w)) + near(F.lead("page").over(w) - F.col("page"))
    rows = rows.withColumns({"boosted": F.round(F.col("score") + boost * n, 9), "_first": F.min("ord").over(doc)})
    return ranked(rows.withColumnRenamed("ord", "_in"), [F.desc("boosted"), F.col("_first"), F.col("page"), F.col("_in")]).drop("_first", "_in")


def diversify(rows: DataFrame, top_k: int, cap: int, floor: float) -> DataFrame:
    """Soft cap of `cap` rows for each document among the first top_k: rows (query_id, document_id, ord from 1, relevance,
    scale). Order: chosen; rows the cap put off, as far as the first top_k has room; all others as they were. Nothing
    changes if the cap is 0 or the list is short."""
    if cap <= 0:
        return rows.withColumn("place", F.col("ord"))
    q, d = Window.partitionBy("query_id"), Window.partitionBy("query_id", "document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    may = ((F.col("ord") <= top_k) | ((F.col("scale") == "cross_encoder") & (F.coalesce("relevance", F.lit(0.0)) >= floor))).cast("int")
    rows = rows.withColumn("_may", F.coalesce(may, F.lit(0)))
    held = F.coalesce(F.sum("_may").over(d), F.lit(0))
    rows = rows.withColumns({"_full": held >= cap, "_n": F.count("*").over(q)})
    rows = rows.withColumn("_sel", (F.col("_may") == 1) & ~F.col("_full"))
    upto = lambda c: F.sum(c.cast("int")).over(q.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_rank": upto(F.col("_sel")), "_late": upto(F.col("_full")), "_chosen": F.least(F.lit(top_k), F.sum(F.col("_sel").cast("int")).over(q))})
    group = F.when(F.col("_sel") & (F.col("_rank") <= top_k), 0).when(F.col("_full") & (F.col("_chosen") + F.col("_late") <= top_k), 1).otherwise(2)
    rows = rows.withColumn("_g", F.when(F.col("_n") <= top_k, 0).otherwise(group))
    return rows.withColumn("place", F.row_number().over(q.orderBy("_g", "ord"))).drop("_may", "_full", "_n", "_sel", "_rank", "_late", "_chosen", "_g")


def evidence_order(rows: DataFrame) -> DataFrame:
    """Documents by their best score, the even ones to the front, the odd ones to the back in reverse; the rows of a single
    document alternate so themselves; lists of up to two stay. place counts from 1."""
    q, d = Window.partitionBy("query_id"), Window.partitionBy("query_id", "document_id")
    out = rows.withColumns({"_n": F.count("*").over(q), "_best": F.max("score").over(d), "_first": F.min("ord").over(d)})
    out = out.withColumns({"_one": F.min("_first").over(q) == F.max("_first").over(q), "_p": F.dense_rank().over(q.orderBy(F.desc("_best"), "_first")) - 1})
    p = F.when(F.col("_one"), F.col("ord") - 1).otherwise(F.col("_p"))
    key = F.when(F.col("_n") <= 2, 0).when(p % 2 == 0, p).otherwise(1_000_000_000 - p)
    return out.withColumn("_key", key).withColumn("place", F.row_number().over(q.orderBy("_key", "ord"))).drop("_n", "_best", "_first", "_one", "_p", "_key")


def representative(rows: DataFrame, limit: int) -> DataFrame:
    """Up to `limit` rows of each document (document_id, ord from 0, readable): readable ones alone if there are enough of
    them (`limit`, three at most), the first two and evenly spread others; where two spread places coincide, the lowest
    place not yet taken stands in, so there are always `limit` different ones."""
    d = Window.partitionBy("document_id")
    enough = F.sum(F.col("readable").cast("int")).over(d) >= min(limit, 3)
    kept = rows.withColumn("_ok", enough).where("readable or not _ok")
    kept = kept.withColumns({"_i": F.row_number().over(d.orderBy("ord")) - 1, "_m": F.count("*").over(d)})
    anchors = min(2, limit)
    steps = F.transform(F.sequence(F.lit(1), F.lit(limit - anchors)), lambda k: F.least(F.col("_m") - 1, F.greatest(F.lit(anchors), F.floor(k / (limit - anchors) * (F.col("_m") - 1) + 0.5)))) if limit > anchors else F.array().cast("array<bigint>")
    first = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), lambda i: i.cast("bigint")), steps))
    spare = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(limit).cast("bigint")), first)
    taken = F.concat(first, F.slice(spare, 1, F.lit(limit) - F.size(first)))
    return kept.where((F.col("_m") <= limit) | F.array_contains(taken, F.col("_i").cast("bigint"))).drop("_ok", "_i", "_m")


def overview(chunks: DataFrame, limit: int) -> DataFrame:
    """Rows that stand for a whole document (document_id, chunk_id, ord from 0, content, context): representative ones in
    order, scored max(0.9, 1 - 0.01 i); content that can't be read gives way to a context of no less quality."""
    rows = chunks.withColumn("readable", ~X.low_readability(F.col("content")) | ~X.low_readability(F.col("context")))
    rows = representative(rows, limit)
    swap = X.low_readability(F.col("content")) & (X.text_quality(F.col("context")) >= X.text_quality(F.col("content")))
    i = F.row_number().over(Window.partitionBy("document_id").orderBy("ord")) - 1
    return rows.withColumns({"score": F.round(F.greatest(F.lit(0.9), 1 - 0.01 * i), 9), "content": F.when(swap, F.col("context")).otherwise(F.col("content"))}).drop("readable")
