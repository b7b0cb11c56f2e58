"""The engine's registered queries and the SQL that gives the same rows.

Every query runs over whole tables. Vector searches take as queries the vectors whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import safety as G
from siftline.functions import tables as FT
from siftline.functions import text as X
from siftline.functions import vector as V
from siftline.operators import answers as W
from siftline.operators import chunking as K
from siftline.operators import metrics as A
from siftline.operators import ranking as R
from siftline.plans.registry import POOL, QUERIES, SQL, pool, query  # noqa: F401
from siftline.sources.tables import table
from siftline.plans import answers_catalog, evaluation_catalog, state_catalog, text_catalog  # noqa: F401  they register their queries
from siftline.streaming.windows import metric_windows

# Pieces of SQL that several queries share.
VEC = """vsim AS (SELECT CAST(q.vec_id / 50 AS BIGINT) AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS ord FROM vsim)"""
KEY = r"""qt AS (SELECT DISTINCT item_id AS query_id, t AS token FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM benchmark) WHERE length(t) >= 3),
post AS (SELECT doc_id AS chunk_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents) WHERE length(token) >= 3 GROUP BY 1, 2),
krank AS (SELECT query_id, chunk_id, round(sum(n) * 0.1::DOUBLE, 6) AS rank FROM post JOIN qt USING (token) GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, chunk_id) AS ord FROM krank)"""
FUSED = f"""{VEC}, {KEY},
fv AS (SELECT query_id, chunk_id, ord AS vector_rank FROM vec WHERE ord <= 20), fk AS (SELECT query_id, chunk_id, ord AS keyword_rank FROM kw WHERE ord <= 20),
fused AS (SELECT query_id, chunk_id, vector_rank, keyword_rank, round(coalesce(1.0 / (60 + vector_rank), 0.0::DOUBLE) + coalesce(1.0 / (60 + keyword_rank), 0.0::DOUBLE), 9) AS score,
  CASE WHEN vector_rank IS NOT NULL AND keyword_rank IS NOT NULL THEN 'hybrid' WHEN vector_rank IS NOT NULL THEN 'vector' ELSE 'keyword' END AS source FROM fv FULL OUTER JOIN fk USING (query_id, chunk_id)),
franked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank NULLS LAST, keyword_rank NULLS LAST, chunk_id) AS ord FROM fused)"""

def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.where(F.col("vec_id") % 50 == 0).select((F.col("vec_id") / 50).cast("long").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("chunk_id"), "embedding")


def keyword_lists(spark, d, k):
    return R.keyword_topk(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), k)


@query(f"WITH {VEC} SELECT query_id, chunk_id, similarity, CAST(ord AS INTEGER) AS ord FROM vec WHERE ord <= 20")
def vector_topk(spark, d):
    return R.vector_topk(*vectors(spark, d), 20)


@query(f"WITH {VEC}, s AS (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS ord FROM vsim JOIN embeddings e ON e.vec_id = chunk_id WHERE label IN (1, 2, 3)) SELECT query_id, chunk_id, similarity, CAST(ord AS INTEGER) AS ord FROM s WHERE ord <= 10")
def vector_topk_scoped(spark, d):
    q, _ = vectors(spark, d)
    return R.vector_topk(q, table(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3)).select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)


@query(f"WITH {VEC} SELECT query_id, chunk_id, similarity, CAST(ord AS INTEGER) AS ord FROM vec WHERE ord <= 10")
def vector_topk_sql(spark, d):
    """The search as a table function that SQL calls."""
    FT.register(spark)
    for rows, name in zip(vectors(spark, d), ("asked_vectors", "indexed_vectors"), strict=True):
        rows.withColumn("embedding", F.col("embedding").cast("array<double>")).createOrReplaceTempView(name)
    return spark.sql(FT.MATCH.format(queries="asked_vectors", chunks="indexed_vectors", parts=int(spark.conf.get("spark.sql.shuffle.partitions", "200")), k=10))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {KEY} SELECT query_id, chunk_id, rank, CAST(ord AS INTEGER) AS ord FROM kw WHERE ord <= 20")
def keyword_topk(spark, d):
    return keyword_lists(spark, d, 20)


@query(f"WITH {FUSED} SELECT query_id, chunk_id, CAST(vector_rank AS INTEGER) AS vector_rank, CAST(keyword_rank AS INTEGER) AS keyword_rank, score, source, CAST(ord AS INTEGER) AS ord FROM franked")
def rrf_fusion(spark, d):
    return R.rrf(R.vector_topk(*vectors(spark, d), 20).drop("similarity"), keyword_lists(spark, d, 20))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, score, source, CAST(ord AS INTEGER) AS ord FROM franked WHERE ord <= 8")
def final_topk(spark, d):
    return rrf_fusion(spark, d).where(F.col("ord") <= 8).select("query_id", "chunk_id", "score", "source", "ord")


@query(f"""WITH {POOL}, s AS (SELECT *, coalesce(similarity, 0.6 * lexical) AS vec, max(score) OVER (PARTITION BY query_id) AS best FROM listed),
t AS (SELECT query_id, chunk_id, score, ord, round(least(greatest(0.55 * CASE WHEN best > 0 THEN score / best ELSE 1 END + 0.30 * lexical + 0.10 * vec + 0.05 * exact + 0.04 * same_language, 0), 1), 9) AS rerank_score, round(least(greatest(0.65 * vec + 0.30 * lexical + 0.05 * exact, 0), 1), 9) AS relevance FROM s)
SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, round(relevance, 6) AS relevance FROM t""")
def heuristic_rerank(spark, d):
    return R.heuristic_rerank(pool(spark, d)).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {POOL}, w AS (SELECT *, page - lag(page) OVER x AS p, lead(page) OVER x - page AS n, min(ord) OVER (PARTITION BY query_id, document_id) AS first FROM listed WINDOW x AS (PARTITION BY query_id, document_id ORDER BY page, ord)),
b AS (SELECT *, round(score + 0.05 * (CASE WHEN p <= 1 THEN 1 ELSE 0 END + CASE WHEN n <= 1 THEN 1 ELSE 0 END), 9) AS boosted FROM w)
SELECT query_id, chunk_id, round(boosted, 6) AS boosted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, first, page, ord) AS INTEGER) AS ord FROM b""")
def adjacency_boost(spark, d):
    return R.adjacency_boost(pool(spark, d)).select("query_id", "chunk_id", F.round("boosted", 6).alias("boosted"), "ord")


@query(f"""WITH {POOL}, m AS (SELECT *, CAST(ord <= 8 OR coalesce(scale = 'cross_encoder' AND coalesce(similarity, 0) >= 0.25, false) AS INTEGER) AS may FROM listed),
h AS (SELECT *, coalesce(sum(may) OVER (PARTITION BY query_id, document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 AS full_, count(*) OVER (PARTITION BY query_id) AS n FROM m),
s AS (SELECT *, may = 1 AND NOT full_ AS sel FROM h),
r AS (SELECT *, count(*) FILTER (sel) OVER w AS rk, count(*) FILTER (full_) OVER w AS late, count(*) FILTER (sel) OVER (PARTITION BY query_id) AS total FROM s WINDOW w AS (PARTITION BY query_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN n <= 8 OR (sel AND rk <= 8) THEN 0 WHEN full_ AND late <= 8 - least(8, total) THEN 1 ELSE 2 END AS grp FROM r)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY grp, ord) AS INTEGER) AS place FROM g""")
def doc_diversity(spark, d):
    return R.diversify(pool(spark, d).withColumn("relevance", F.col("similarity")), 8, 3, 0.25).select("query_id", "chunk_id", "place")


@query(f"""WITH {POOL}, b AS (SELECT query_id, chunk_id, 0 AS branch, 1.0::DOUBLE AS weight, ord FROM listed WHERE ord <= 20 UNION ALL
SELECT query_id, chunk_id, 1, 0.9::DOUBLE, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, chunk_id) FROM pool),
f AS (SELECT query_id, chunk_id, round(sum(weight / (60 + ord)), 6) AS score, CAST(max(branch) AS INTEGER) AS kept_branch FROM b GROUP BY 1, 2) SELECT * FROM f""")
def branch_fusion(spark, d):
    p = pool(spark, d)
    one = p.where(F.col("ord") <= 20).select("query_id", "chunk_id", F.lit(0).alias("branch"), F.lit(1.0).alias("weight"), "ord")
    two = R.ranked(p.drop("ord"), [F.desc("lexical"), F.col("chunk_id")]).select("query_id", "chunk_id", F.lit(1).alias("branch"), F.lit(0.9).alias("weight"), "ord")
    return R.weighted_fusion(one.unionByName(two)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "kept_branch")


@query(f"""WITH {POOL}, r AS (SELECT query_id, document_id, lexical AS relevance, chunk_id, ord, row_number() OVER (PARTITION BY query_id, document_id ORDER BY lexical DESC, ord) AS k, min(ord) OVER (PARTITION BY query_id, document_id) AS first FROM listed)
SELECT query_id, document_id, chunk_id, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, first) AS INTEGER) AS ord FROM r WHERE k = 1""")
def pool_merge(spark, d):
    rows = pool(spark, d).select("query_id", "document_id", "chunk_id", "ord", F.col("lexical").alias("relevance"))
    return R.pool_merge(rows, "document_id").select("query_id", "document_id", "chunk_id", "relevance", "ord")


@query(f"""WITH {POOL}, v AS (SELECT query_id, chunk_id % 17 AS chunk_id, doc_id_part AS variation, ord, score FROM (SELECT *, chunk_id % 3 AS doc_id_part FROM listed)), g AS (SELECT query_id, chunk_id, max(score) AS score, min(variation * 1000000 + ord) AS first FROM v GROUP BY 1, 2)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS ord FROM g""")
def variation_merge(spark, d):
    c = F.col("chunk_id")
    return R.variation_merge(pool(spark, d).select("query_id", (c % 3).alias("variation"), "ord", (c % 17).alias("chunk_id"), "score"))


@query(f"""WITH {POOL}, n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, count(DISTINCT document_id) OVER (PARTITION BY query_id) AS docs, max(score) OVER (PARTITION BY query_id, document_id) AS best, min(ord) OVER (PARTITION BY query_id, document_id) AS first FROM listed),
p AS (SELECT *, CASE WHEN docs = 1 THEN ord - 1 ELSE dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, first) - 1 END AS p FROM n)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 2 THEN 0 WHEN p % 2 = 0 THEN p ELSE 1000000000 - p END, ord) AS INTEGER) AS place FROM p""")
def evidence_order(spark, d):
    return R.evidence_order(pool(spark, d)).select("query_id", "chunk_id", "place")


@query(f"""WITH {POOL}, s AS (SELECT query_id, chunk_id, ord, lexical AS s, ord <= 20 AS capped FROM listed WHERE chunk_id % 997 <> 5 OR ord > 20), a AS (SELECT query_id, min(CASE WHEN ord <= 20 AND chunk_id % 997 = 5 THEN 0 ELSE 1 END) AS ok FROM listed GROUP BY 1),
r AS (SELECT l.query_id, l.chunk_id, l.ord, l.lexical, ok = 1 AND l.ord <= 20 AS fresh FROM listed l JOIN a USING (query_id))
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fresh THEN 0 ELSE 1 END, CASE WHEN fresh THEN -lexical END, ord) AS INTEGER) AS ord, CASE WHEN fresh THEN lexical END AS relevance FROM r""")
def cross_encoder(spark, d):
    """The lexical score as the provider's, missing for a few rows, whose queries so keep their order."""
    p = pool(spark, d).select("query_id", "chunk_id", "ord", "lexical")
    scores = p.where("chunk_id % 997 <> 5").select("query_id", "chunk_id", F.col("lexical").alias("score"))
    return R.cross_encoder(p, scores, 20).select("query_id", "chunk_id", "ord", "relevance")


@query(f"""WITH {POOL} SELECT chunk_id, CASE WHEN coalesce(context, '') = '' THEN left(title || chr(10) || content, 4096) ELSE left(title || chr(10) || context, 1024) || chr(10) || left(content, 4096 - length(left(title || chr(10) || context, 1024)) - 1) END AS text FROM pool""")
def encoder_text(spark, d):
    return pool(spark, d).select("chunk_id", R.encoder_text(F.col("title"), F.col("context"), F.col("content"), True).alias("text"))


@query(r"""WITH r AS (SELECT doc_id // 40 AS document_id, doc_id AS chunk_id, n_chars % 5 > 0 AS readable, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) - 1 AS ord FROM documents WHERE doc_id // 40 % 4 > 0 OR doc_id % 40 < 9),
e AS (SELECT *, count(*) FILTER (readable) OVER (PARTITION BY document_id) >= 3 AS enough FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS m FROM e WHERE readable OR NOT enough),
t AS (SELECT *, list_distinct(list_concat([0, 1], list_transform(range(1, 7), lambda j: CAST(least(m - 1, greatest(2, floor(j / 6.0 * (m - 1) + 0.5))) AS BIGINT)))) AS first FROM k),
u AS (SELECT *, list_concat(first, list_slice(list_sort(list_filter(range(0, 9), lambda x: NOT list_contains(first, x))), 1, 8 - len(first))) AS taken FROM t)
SELECT document_id, chunk_id FROM u WHERE m <= 8 OR list_contains(taken, i)""")
def overview_rows(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").where((F.floor(i / 40) % 4 > 0) | (i % 40 < 9)).select(F.floor(i / 40).alias("document_id"), i.alias("chunk_id"), (F.col("n_chars") % 5 > 0).alias("readable"))
    return R.representative(R.ranked(rows, [F.col("chunk_id")], by="document_id"), 8).select("document_id", "chunk_id")


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) AS q FROM documents")
def normalize_query(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_query(F.col("text")).alias("q"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS l FROM documents)
SELECT doc_id, CAST(least(32, length(list_distinct(l))) AS INTEGER) AS n_tokens, coalesce(l[1], '') AS first_token FROM l""")
def query_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.query_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.coalesce(F.get("t", 0), F.lit("")).alias("first_token"))


_count = lambda k: " + ".join(f"(length(p) - length(replace(p, '{w}', ''))) / {len(w)}" for w in X.LANGUAGE_KEYWORDS[k])


@query(f"""WITH t AS (SELECT doc_id, ' ' || lower(text) || ' ' AS p FROM documents), c AS (SELECT doc_id, {", ".join(f"CAST({_count(k)} AS INTEGER) AS {k.lower()}" for k in X.LANGUAGE_KEYWORDS)} FROM t) SELECT * FROM c""")
def language_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", *(X.keyword_count(F.col("text"), k).alias(k.lower()) for k in X.LANGUAGE_KEYWORDS))


_LETTERS, _PRINTED, _ODD = r"[\p{L}]", r"[\p{L}\p{N}\p{P}\p{Zs}]", r"[^\p{L}\p{N}\p{P}\p{Zs}]"
_share = lambda p: f"(length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / length(text)::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE round(0.55 * {_share(_LETTERS)} + 0.35 * {_share(_PRINTED)} + 0.1 * (1 - {_share(_ODD)}), 6) END AS quality FROM documents")
def text_quality(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.text_quality(F.col("text")), 6).alias("quality"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM documents""")
def sanitize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.sanitize(F.col("text")).alias("text"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, length(l) >= 6 AND list_sum(list_transform(list_distinct(l), lambda x: length(x))) / list_sum(list_transform(l, lambda x: length(x))) < 0.55 AS repetitive FROM l""")
def repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", X.repetitive(F.col("text")).alias("repetitive"))


@query("SELECT doc_id, CAST(" + " + ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN {n} ELSE 0 END" for _, p, n in G.INJECTION) + " AS INTEGER) AS score FROM documents")
def injection_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", G.injection_score(F.col("text")).alias("score"))


_rules = lambda x: [f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for _, p, _ in G.INJECTION]
_score = lambda x: " + ".join(f"CASE WHEN {r} THEN {n} ELSE 0 END" for r, (_, _, n) in zip(_rules(x), G.INJECTION, strict=True))
_blocks = " OR ".join(r for r, (k, _, _) in zip(_rules("text"), G.INJECTION, strict=True) if k in G.BLOCKING)


@query(f"SELECT doc_id, trim(array_to_string(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: NOT ({' OR '.join(_rules('x'))})), chr(10))) AS text, {_score('text')} >= 10 OR {_blocks} AS blocked FROM documents WHERE text IS NOT NULL")
def injection_lines(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", G.safe_lines(F.col("text")).alias("text"), G.injection_blocked(F.col("text")).alias("blocked"))


@query("SELECT doc_id, CASE WHEN length(text) > 24000 THEN left(text, 23900) || chr(10) || chr(10) || '[Truncated]' ELSE text END AS text FROM documents")
def length_guard(spark, d):
    return table(spark, d, "documents").select("doc_id", G.length_guard(F.col("text")).alias("text"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((length(w) - 40) / 160.0) AS BIGINT)))) AS chunk_index FROM w WHERE length(w) > 0)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(length(list_slice(w, chunk_index * 160 + 1, chunk_index * 160 + 200)) AS INTEGER) AS n_words, array_to_string(list_slice(w, chunk_index * 160 + 1, chunk_index * 160 + 200), ' ') AS content FROM c""")
def fixed_windows(spark, d):
    return K.fixed_windows(table(spark, d, "documents"))


@query("""WITH r AS (SELECT doc_id // 100 AS doc, doc_id, upper(lang) AS language FROM documents), c AS (SELECT *, CASE WHEN language <> lag(language) OVER (PARTITION BY doc ORDER BY doc_id) THEN 1 ELSE 0 END AS c FROM r),
s AS (SELECT *, sum(c) OVER (PARTITION BY doc ORDER BY doc_id) AS run FROM c) SELECT CAST(doc AS BIGINT) AS doc_id, CAST(run AS BIGINT) AS run, any_value(language) AS language, min(doc_id) AS first_ord, max(doc_id) AS last_ord, count(*) AS n FROM s GROUP BY doc, run""")
def lang_runs(spark, d):
    rows = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 100).alias("doc_id"), F.col("doc_id").alias("ord"), F.upper("lang").alias("language"))
    return K.language_runs(rows)


@query("""WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x::DOUBLE), 6) AS mean FROM u GROUP BY 1, 2""")
def centroid(spark, d):
    return A.centroid(table(spark, d, "embeddings"), "label")


@query("""WITH w AS (SELECT lang, doc_id FROM documents), c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS r FROM c) SELECT source, upper(lang) AS language, n FROM r WHERE r = 1""")
def mode_language(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return c.groupBy("source").agg(F.max_by(F.struct("lang", "n"), F.struct("n", -F.col("first"))).alias("b")).select("source", F.upper("b.lang").alias("language"), "b.n")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def metric_rollup(spark, d):
    return metric_windows(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""WITH {VEC}, want AS (SELECT DISTINCT CAST(q.vec_id / 50 AS BIGINT) AS query_id, c.vec_id AS chunk_id FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0), n AS (SELECT query_id, count(*) AS n FROM want GROUP BY 1),
g AS (SELECT query_id, min(ord) AS first, sum(CASE WHEN ord <= 10 THEN 1 / log2(ord + 1) END) AS dcg FROM vec JOIN want USING (query_id, chunk_id) WHERE ord <= 20 GROUP BY 1)
SELECT n.query_id, coalesce(CAST(first <= 5 AS INTEGER), 0) AS recall_at_5, round(coalesce(1.0 / first, 0.0), 6)::DOUBLE AS mrr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, n.n) + 1) t(i)), 6) AS ndcg_at_10 FROM n LEFT JOIN g USING (query_id)""")
def ir_metrics(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 50 == 0).select((F.col("vec_id") / 50).cast("long").alias("query_id"), "label")
    return A.labelled_metrics(R.vector_topk(*vectors(spark, d), 20), q, e.select(F.col("vec_id").alias("chunk_id"), "label"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS turns FROM conversations GROUP BY 1""")
def transcripts(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("x")))).alias("a"))
    return rows.select("conv_id", F.array_join(F.transform("a", lambda r: r.x), "\n").alias("transcript"), F.size("a").cast("long").alias("turns"))


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def history_page(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_orderdate")


@query(r"""WITH g AS (SELECT conv_id, turn, list_distinct(list_transform(flatten(list_transform(regexp_extract_all(text, '\[([0-9]{1,6}(?:\s*,\s*[0-9]{1,6})*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*'))), lambda x: CAST(x AS INTEGER))) AS c FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, CAST(len(list_filter(c, lambda x: x BETWEEN 1 AND 8)) AS INTEGER) AS valid, CAST(len(list_filter(c, lambda x: NOT x BETWEEN 1 AND 8)) AS INTEGER) AS out_of_range FROM g""")
def citation_markers(spark, d):
    c = W.cited(F.col("text"), F.lit(8))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(c["valid"]).alias("valid"), c["out_of_range"].alias("out_of_range"))


SOURCES = """c AS (SELECT l_orderkey AS answer_id, l_suppkey AS document_id, min(l_linenumber) AS pos, list_sort(list_distinct(list(l_quantity::BIGINT))) AS pages FROM lineitem GROUP BY 1, 2),
listed AS (SELECT answer_id, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY pos, document_id) AS INTEGER) AS ord, document_id, CASE WHEN s_suppkey IS NULL THEN 'Nicht mehr vorhandenes Dokument' ELSE coalesce(s_name, 'Unbenanntes Dokument') END AS title, pages FROM c LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = document_id)"""


def source_lists(spark, d):
    cites = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("document_id"), F.col("l_quantity").cast("long").alias("page_number"))
    return W.sources(cites, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("document_id"), F.col("s_name").alias("title")))


@query(f"WITH {SOURCES} SELECT answer_id, ord, document_id, title, array_to_string(pages, ',') AS pages FROM listed")
def citation_sources(spark, d):
    return source_lists(spark, d).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(f"WITH {SOURCES} SELECT answer_id, string_agg('- ' || title || ' (' || CASE WHEN len(pages) = 1 THEN 'page ' ELSE 'pages ' END || array_to_string(pages, ', ') || ')', chr(10) ORDER BY ord) AS markdown FROM listed GROUP BY 1")
def source_markdown(spark, d):
    return W.source_lines(source_lists(spark, d))


@query("""SELECT event_type, count(*) AS n, min(value) AS least, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1""")
def slice_statistics(spark, d):
    return A.slice_statistics(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


_outcome = "CASE WHEN query_id % 3 > 0 THEN 'answerable' WHEN query_id % 2 = 0 THEN 'unanswerable_abstained' ELSE 'unanswerable_answered' END"


@query(f"""WITH {POOL}, t AS (SELECT query_id, max(CASE WHEN ord = 1 THEN lexical END) AS top1, avg(lexical) AS top3mean FROM listed WHERE ord <= 3 GROUP BY 1),
u AS (SELECT {_outcome} AS slice, 'top1' AS stat, top1 AS v FROM t UNION ALL SELECT {_outcome}, 'top3mean', top3mean FROM t)
SELECT slice, stat, count(*) AS n, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS most, round(avg(v), 6) AS mean FROM u GROUP BY 1, 2""")
def calibration_slices(spark, d):
    chunks = pool(spark, d).select("query_id", "ord", F.col("lexical").alias("relevance"))
    q = F.col("query_id")
    results = chunks.select("query_id").distinct().select(q, F.when(q % 3 > 0, "fact").otherwise("unanswerable").alias("question_type"), (q % 2 == 0).alias("insufficient"))
    out = A.calibration_slices(results, chunks)
    return out.select("slice", "stat", "n", *(F.round(c, 6).alias(c) for c in ("least", "p25", "p50", "p75", "p90", "most", "mean")))


@query("""WITH e AS (SELECT max(score) FILTER (NOT ok) AS unanswerable_max, min(score) FILTER (ok) AS answerable_min FROM (SELECT n_chars / 100000.0::DOUBLE AS score, quality = 1 AS ok FROM labels JOIN documents USING (doc_id)))
SELECT *, CASE WHEN unanswerable_max < answerable_min THEN least(unanswerable_max + 0.02, answerable_min - 0.01) END AS threshold FROM e""")
def threshold_separation(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("score", F.col("n_chars") / 100000)
    return A.separation(rows, "score", F.col("quality") == 1)
