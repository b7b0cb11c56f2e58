"""Queries on evaluation, drift, health and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import answers as W
from siftline.operators import evaluation as V
from siftline.operators import metrics as A
from siftline.operators import queue as Q
from siftline.operators import ranking as R
from siftline.plans import state_catalog as C
from siftline.plans.registry import NOW, POOL, pool, query
from siftline.sources import tables as T
from siftline.sources.tables import jobs, table
from siftline.streaming.windows import alerts, metric_windows, sentences

# The golden set: a record for each pool, some by chunk ids, some by document, section and pages, some unanswerable.
GOLDEN = f"""{POOL}, golden AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN list(chunk_id ORDER BY chunk_id) FILTER (chunk_id % 7 = 2) ELSE [] END AS chunk_ids, 3::BIGINT AS document, CASE WHEN query_id % 2 = 0 THEN 'WEB' ELSE '' END AS section, [1, 2, 3] AS pages FROM pool GROUP BY 1),
marked AS (SELECT l.*, coalesce(CASE WHEN len(g.chunk_ids) > 0 THEN list_contains(g.chunk_ids, l.chunk_id) ELSE l.document_id = g.document AND list_contains(g.pages, l.page) AND (g.section = '' OR coalesce(l.title, '') = '' OR contains(lower(l.title), lower(g.section)) OR contains(lower(g.section), lower(l.title))) END, false) AS relevant,
  coalesce(CASE WHEN len(g.chunk_ids) > 0 THEN list_contains(g.chunk_ids, l.chunk_id) ELSE l.document_id = g.document AND list_contains(g.pages, l.page) END, false) AS cited_right FROM listed l JOIN golden g USING (query_id))"""


def golden(spark, d):
    q = F.col("query_id")
    ids = F.array_sort(F.collect_list(F.when(F.col("chunk_id") % 7 == 2, F.col("chunk_id"))))
    g = pool(spark, d).groupBy("query_id").agg(ids.alias("_ids"))
    none = F.array().cast("array<bigint>")
    return g.select("query_id", F.when(q % 3 == 0, F.col("_ids")).otherwise(none).alias("chunk_ids"), F.lit(3).cast("long").alias("document"), F.when(q % 2 == 0, "WEB").otherwise("").alias("section"), F.array(*map(F.lit, (1, 2, 3))).alias("pages"))


def results(spark, d):
    return pool(spark, d).select("query_id", "ord", "chunk_id", "document_id", "page", F.col("title").alias("section"))


@query(f"WITH {GOLDEN} SELECT query_id, chunk_id, relevant FROM marked")
def golden_relevance(spark, d):
    return V.relevance(results(spark, d), golden(spark, d)).select("query_id", "chunk_id", "relevant")


@query(f"""WITH {GOLDEN}, h AS (SELECT query_id, min(ord) AS first_rank, sum(1 / log2(ord + 1)) AS dcg, count(*) AS found FROM marked WHERE relevant AND ord <= 10 GROUP BY 1),
n AS (SELECT g.query_id, first_rank, dcg, least(10, greatest(1, CASE WHEN len(chunk_ids) > 0 THEN len(chunk_ids) ELSE len(pages) END, coalesce(found, 0))) AS n FROM golden g LEFT JOIN h USING (query_id))
SELECT query_id, coalesce(CAST(first_rank <= 5 AS INTEGER), 0) AS recall_at_5, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, n.n + 1) t(i)), 6) AS ndcg_at_10, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr, CAST(first_rank AS INTEGER) AS first_rank FROM n""")
def retrieval_metrics(spark, d):
    g = golden(spark, d)
    return V.retrieval(V.relevance(results(spark, d), g), g)


@query(f"WITH {GOLDEN}, c AS (SELECT query_id, avg(CAST(cited_right AS DOUBLE)) AS a, max(CAST(cited_right AS INTEGER)) AS h FROM marked WHERE ord <= 4 GROUP BY 1) SELECT query_id, round(coalesce(a, 0), 6) AS accuracy, coalesce(h, 0) AS evidence_hit FROM golden LEFT JOIN c USING (query_id)")
def citation_quality(spark, d):
    return V.citation_quality(results(spark, d).where("ord <= 4").select("query_id", "chunk_id", "document_id", "page"), golden(spark, d))


@query(r"""WITH a AS (SELECT doc_id AS query_id, text AS answer, [left(text, 40), 'zzz qqq'] AS points, doc_id % 9 = 0 AS insufficient FROM documents WHERE text IS NOT NULL),
k AS (SELECT query_id, list_distinct(flatten(list_transform([coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || substr(text, 300, 300), points[1], points[2]], lambda t: list_filter(regexp_split_to_array(trim(regexp_replace(lower(t), '\s+', ' ', 'g')), '[^a-z0-9À-ɏ]+'), lambda w: length(w) >= 2)))) AS words FROM a JOIN documents ON doc_id = query_id),
s AS (SELECT query_id, points, insufficient, answer, trim(unnest(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM a),
n AS (SELECT s.*, words, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) AS t FROM s JOIN k USING (query_id) WHERE s <> ''),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[^a-z0-9À-ɏ]+'), lambda x: length(x) >= 2) AS tok FROM n),
u AS (SELECT *, len(list_filter(points, lambda p: trim(regexp_replace(lower(p), '\s+', ' ', 'g')) <> '' AND (contains(t, trim(regexp_replace(lower(p), '\s+', ' ', 'g'))) OR contains(trim(regexp_replace(lower(p), '\s+', ' ', 'g')), t)))) > 0 OR len(tok) = 0 OR len(list_filter(tok, lambda x: list_contains(words, x))) / len(tok)::DOUBLE >= 0.35 AS ok FROM w),
g AS (SELECT query_id, avg(CAST(ok AS DOUBLE)) AS g FROM u GROUP BY 1)
SELECT a.query_id, CASE WHEN NOT insufficient THEN round(coalesce(g, 0), 6) END AS grounding, round(1 - CASE WHEN NOT insufficient THEN round(coalesce(g, 0), 6) END, 6) AS hallucination FROM a LEFT JOIN g USING (query_id)""")
def grounding(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    answers = rows.select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"), F.array(F.left("text", F.lit(40)), F.lit("zzz qqq")).alias("points"), (F.col("doc_id") % 9 == 0).alias("insufficient"))
    chunks = rows.select(F.col("doc_id").alias("query_id"), F.col("source").alias("title"), F.col("lang").alias("context"), F.substring("text", 300, 300).alias("content"))
    return V.grounding(answers, chunks)


@query(f"""WITH t AS (SELECT doc_id, string_split(text || chr(10) || '## Limitations' || chr(10) || 'nothing is known' || chr(10) || '### more' || chr(10) || 'of it' || chr(10) || '## Sources' || chr(10) || 'end', chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM t), h AS (SELECT *, count(*) FILTER (regexp_matches(x, '^#{{1,2}}\\s')) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM u),
k AS (SELECT *, g > 0 AND regexp_matches(first(x) OVER (PARTITION BY doc_id, g ORDER BY i), '{V.LIMITATIONS}') AS skip FROM h) SELECT doc_id, rtrim(string_agg(x, chr(10) ORDER BY i) FILTER (NOT skip), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM k GROUP BY 1""")
def without_limitations(spark, d):
    text = F.concat("text", F.lit("\n## Limitations\nnothing is known\n### more\nof it\n## Sources\nend"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", V.without_limitations(text).alias("text"))


RESULTS = """res AS (SELECT l.doc_id AS query_id, upper(lang) AS language, CASE WHEN l.doc_id % 5 = 0 THEN 'unanswerable' ELSE 'factual' END AS question_type, CASE WHEN l.doc_id % 37 = 0 THEN 'timeout' END AS error, quality::DOUBLE AS recall_at_5, (n_chars % 10) / 10.0::DOUBLE AS ndcg_at_10, 1 / (1.0::DOUBLE + n_chars % 4) AS mrr,
(n_chars % 7) / 6.0::DOUBLE AS citation_accuracy, (n_chars % 2)::INTEGER AS citation_evidence_hit, CASE WHEN n_chars % 3 > 0 THEN (n_chars % 5) / 4.0::DOUBLE END AS verified_citation_rate, CASE WHEN l.doc_id % 6 > 0 THEN (n_chars % 9) / 8.0::DOUBLE END AS grounding, CASE WHEN l.doc_id % 6 > 0 THEN 1 - (n_chars % 9) / 8.0::DOUBLE END AS hallucination_rate,
l.doc_id % 3 = 0 AS cache_hit, n_chars AS uncached_ms, n_chars // 2 AS cached_ms, toxic = 1 AS insufficient, l.doc_id % 11 = 0 AS truncated, l.doc_id % 4 > 0 AS judged, l.doc_id % 8 = 1 AS judge_abstained,
CASE WHEN l.doc_id % 10 > 0 THEN (n_chars % 6) / 5.0::DOUBLE END AS faithfulness, (n_chars % 3) / 2.0::DOUBLE AS answer_relevance, CASE WHEN l.doc_id % 7 > 0 THEN (n_chars % 4) / 3.0::DOUBLE END AS context_precision, (n_chars % 8) / 7.0::DOUBLE AS context_recall FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def benchmark(spark, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return j.select(
        i.alias("query_id"), F.upper("lang").alias("language"), F.when(i % 5 == 0, "unanswerable").otherwise("factual").alias("question_type"), F.when(i % 37 == 0, "timeout").alias("error"),
        F.col("quality").cast("double").alias("recall_at_5"), ((n % 10) / 10).alias("ndcg_at_10"), (1 / (1 + n % 4)).alias("mrr"), ((n % 7) / 6).alias("citation_accuracy"), (n % 2).cast("int").alias("citation_evidence_hit"),
        F.when(n % 3 > 0, (n % 5) / 4).alias("verified_citation_rate"), F.when(i % 6 > 0, (n % 9) / 8).alias("grounding"), F.when(i % 6 > 0, 1 - (n % 9) / 8).alias("hallucination_rate"), (i % 3 == 0).alias("cache_hit"),
        n.alias("uncached_ms"), F.floor(n / 2).alias("cached_ms"), (F.col("toxic") == 1).alias("insufficient"), (i % 11 == 0).alias("truncated"), (i % 4 > 0).alias("judged"), (i % 8 == 1).alias("judge_abstained"),
        F.when(i % 10 > 0, (n % 6) / 5).alias("faithfulness"), ((n % 3) / 2).alias("answer_relevance"), F.when(i % 7 > 0, (n % 4) / 3).alias("context_precision"), ((n % 8) / 7).alias("context_recall"),
    )


_mean = lambda c, w: f"coalesce(round(avg(CAST({c} AS DOUBLE)) FILTER ({w}), 6), 0) AS {c}"
_rate = lambda c, w, n: f"coalesce(round(avg(CAST({c} AS DOUBLE)) FILTER ({w}), 6), 0) AS {n}"
_rank = lambda c, p, n: f"coalesce(CAST(quantile_disc({c}, {p}) FILTER (ok) AS DOUBLE), 0) AS {n}"
_FIGURES = ", ".join(
    ["count(*) FILTER (language = language) AS n", "count(*) FILTER (ok) AS evaluated", "count(*) FILTER (NOT ok) AS system_errors", "count(*) FILTER (can) AS answerable", "count(*) FILTER (cannot) AS unanswerable", _rate("NOT insufficient", "cannot", "false_answer_rate"), _rate("insufficient", "can", "false_abstention_rate")]
    + [_mean(c, "can") for c in ("recall_at_5", "ndcg_at_10", "mrr", "citation_accuracy", "grounding", "hallucination_rate", "citation_evidence_hit", "verified_citation_rate")]
    + ["count(grounding) FILTER (can) AS grounded_queries", "count(verified_citation_rate) FILTER (can) AS verified_queries", _mean("cache_hit", "ok")]
    + [_rank("uncached_ms", 0.5, "uncached_p50"), _rank("uncached_ms", 0.95, "uncached_p95"), _rank("cached_ms", 0.5, "cached_p50"), _rank("cached_ms", 0.95, "cached_p95"), _rate("NOT ok", "true", "system_error_rate"), "count(*) FILTER (can AND judged) AS judged"]
    + [_mean(c, "can AND judged") for c in ("faithfulness", "answer_relevance", "context_precision", "context_recall")]
    + [_rate("judge_abstained", "can AND judged", "abstention_rate"), _rate("truncated", "true", "truncation_rate")]
)
SUMMARY = f"""{RESULTS}, f AS (SELECT * REPLACE (x.language AS language), error IS NULL AS ok, error IS NULL AND question_type <> 'unanswerable' AS can, error IS NULL AND question_type = 'unanswerable' AS cannot FROM res, LATERAL (SELECT unnest([res.language, 'ALL']) AS language) x),
g AS (SELECT language, {_FIGURES} FROM f GROUP BY 1), summary AS (SELECT l.language, COLUMNS(g.* EXCLUDE (language)) FROM (SELECT unnest(['ALL', 'EN', 'DE', 'FR', 'IT', 'ES']) AS language) l LEFT JOIN g ON g.language = l.language)"""
_NAMES = "n evaluated system_errors answerable unanswerable false_answer_rate false_abstention_rate recall_at_5 ndcg_at_10 mrr citation_accuracy grounding hallucination_rate citation_evidence_hit verified_citation_rate grounded_queries verified_queries cache_hit uncached_p50 uncached_p95 cached_p50 cached_p95 system_error_rate judged faithfulness answer_relevance context_precision context_recall abstention_rate truncation_rate".split()
SUMMARY = SUMMARY[: SUMMARY.index(", summary AS")] + ", summary AS (SELECT l.language, " + ", ".join(f"coalesce(g.{c}, 0) AS {c}" for c in _NAMES) + " FROM (SELECT unnest(['ALL', 'EN', 'DE', 'FR', 'IT', 'ES']) AS language) l LEFT JOIN g ON g.language = l.language)"


@query(f"WITH {SUMMARY} SELECT * FROM summary")
def benchmark_summary(spark, d):
    return V.summary(benchmark(spark, d))


_t = V.THRESHOLDS
_GATES = [("Recall@5", "recall_at_5", ">=", "recallAt5", "true"), ("nDCG@10", "ndcg_at_10", ">=", "ndcgAt10", "true"), ("Citation evidence hit rate", "citation_evidence_hit", ">=", "citationEvidenceHitRate", "true"), ("Verified citation rate", "verified_citation_rate", ">=", "verifiedCitationRate", "verified_queries > 0"), ("Faithfulness (LLM judge)", "faithfulness", ">=", "faithfulnessMin", "judged > 0"), ("False answer rate (unanswerable slice)", "false_answer_rate", "<=", "falseAnswerRateMax", "true"), ("False abstention rate (answerable slice)", "false_abstention_rate", "<=", "falseAbstentionRateMax", "true"), ("Cache hit rate", "cache_hit", ">=", "cacheHitRate", "true"), ("Uncached p50 latency (ms)", "uncached_p50", "<", "uncachedP50LatencyMs", "true"), ("Uncached p95 latency (ms)", "uncached_p95", "<", "uncachedP95LatencyMs", "true"), ("Cached p50 latency (ms)", "cached_p50", "<", "cachedP50LatencyMs", "true"), ("Cached p95 latency (ms)", "cached_p95", "<", "cachedP95LatencyMs", "true")]


@query(f"WITH {SUMMARY} " + " UNION ALL ".join([f"SELECT '{n}' AS metric, {c} AS value, '{op} {_t[k]:g}' AS target, {c} {op} {_t[k]} AND {need} AS passed FROM summary WHERE language = 'ALL'" + (" AND unanswerable > 0" if c == "false_answer_rate" else "") for n, c, op, k, need in _GATES] + [f"SELECT '{n} [' || language || ']', {c}, '>= {_t[k]:g}', {c} >= {_t[k]} FROM summary WHERE language <> 'ALL' AND answerable >= 5" for n, c, k in (("Recall@5", "recall_at_5", "perLanguageRecallAt5"), ("nDCG@10", "ndcg_at_10", "perLanguageNdcgAt10"))]))
def release_gates(spark, d):
    return V.gates(V.summary(benchmark(spark, d)))


@query(f"""WITH {RESULTS}, k AS (SELECT query_id, unnest([CASE WHEN insufficient <> (question_type = 'unanswerable') THEN 'abstention' END, CASE WHEN question_type <> 'unanswerable' AND recall_at_5 < 1 THEN 'retrieval' END, CASE WHEN question_type <> 'unanswerable' AND citation_evidence_hit < 1 THEN 'citation' END,
CASE WHEN question_type <> 'unanswerable' AND verified_citation_rate < 0.9 THEN 'citation' END, CASE WHEN question_type <> 'unanswerable' AND judged AND faithfulness < 0.9 THEN 'grounding' END, CASE WHEN uncached_ms >= 15000 OR cached_ms >= 12000 THEN 'latency' END, CASE WHEN NOT cache_hit THEN 'cache' END]) AS failure FROM res)
SELECT query_id, failure, count(*) AS n FROM k WHERE failure IS NOT NULL GROUP BY 1, 2""")
def query_failures(spark, d):
    return V.failures(benchmark(spark, d))


@query(f"""WITH {RESULTS}, s AS (SELECT query_id, recall_at_5, ndcg_at_10, mrr, citation_accuracy, citation_evidence_hit::DOUBLE AS citation_evidence_hit, verified_citation_rate, hallucination_rate, insufficient::INTEGER::DOUBLE AS abstained, CASE WHEN judged THEN faithfulness END AS faithfulness, CASE WHEN judged THEN answer_relevance END AS answer_relevance, CASE WHEN judged THEN context_precision END AS context_precision, CASE WHEN judged THEN context_recall END AS context_recall FROM res)
UNPIVOT s ON COLUMNS(* EXCLUDE (query_id)) INTO NAME name VALUE value""")
def query_scores(spark, d):
    return V.scores(benchmark(spark, d))


@query("""WITH v AS (SELECT doc_id, list_transform(range(0, doc_id % 5), lambda k: (k + doc_id) % 3 = 0) AS v, doc_id % 4 AS want, n_chars / 5000.0::DOUBLE AS x FROM documents)
SELECT doc_id, CASE WHEN want > 0 AND len(v) = want THEN round(len(list_filter(v, lambda b: b)) / want::DOUBLE, 6) END AS fraction, round(least(greatest(x, 0), 1), 6) AS clamped FROM v""")
def judge_fractions(spark, d):
    i = F.col("doc_id")
    v = F.when(i % 5 > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), i % 5 - 1), lambda k: (k + i) % 3 == 0)).otherwise(F.array().cast("array<boolean>"))
    return table(spark, d, "documents").select("doc_id", F.round(V.fraction(v, i % 4), 6).alias("fraction"), F.round(V.clamp(F.col("n_chars") / 5000), 6).alias("clamped"))


@query("""WITH r AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 11 > 0 THEN list_transform(range(0, doc_id % 5), lambda k: (k + doc_id) % 3 = 0) END AS s, CASE WHEN doc_id % 11 > 0 THEN n_chars / 5000.0::DOUBLE END AS x,
CASE WHEN doc_id % 11 > 0 THEN list_transform(range(0, doc_id % 4), lambda k: k % 2 = 0) END AS c, doc_id % 4 AS n, doc_id % 7 = 0 AS refused FROM documents)
SELECT query_id, s IS NOT NULL AS judged, CASE WHEN s IS NULL THEN NULL WHEN len(s) = 0 THEN 1.0 ELSE round(len(list_filter(s, lambda v: v)) / len(s)::DOUBLE, 6) END::DOUBLE AS faithfulness, CASE WHEN s IS NULL THEN NULL WHEN refused THEN 0.0 ELSE round(least(greatest(x, 0), 1), 6) END::DOUBLE AS answer_relevance,
CASE WHEN s IS NOT NULL AND n > 0 THEN round(len(list_filter(c, lambda v: v)) / n::DOUBLE, 6) END AS context_precision, CASE WHEN s IS NULL THEN NULL ELSE CAST(len(s) - len(list_filter(s, lambda v: v)) AS INTEGER) END AS unsupported FROM r""")
def judge_scores(spark, d):
    i, there = F.col("doc_id"), F.col("doc_id") % 11 > 0
    listed = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), f)).otherwise(F.array().cast("array<boolean>"))
    chunks = F.when(there, listed(i % 4, lambda k: k % 2 == 0))
    rows = table(spark, d, "documents").select(i.alias("query_id"), F.when(there, listed(i % 5, lambda k: (k + i) % 3 == 0)).alias("statements"), F.when(there, F.col("n_chars") / 5000).alias("relevance"), chunks.alias("chunk_relevant"), chunks.alias("points_covered"), (i % 4).alias("n_chunks"), (i % 4 + 1).alias("n_points"), (i % 7 == 0).alias("insufficient"))
    out = V.judged(rows)
    return out.select("query_id", "judged", *(F.round(c, 6).alias(c) for c in ("faithfulness", "answer_relevance", "context_precision")), "unsupported")


@query(f"""WITH {POOL}, b AS (SELECT query_id, chunk_id, ord, len(string_split(content, ' ')) AS n_tokens FROM listed), c AS (SELECT *, sum(n_tokens) OVER w AS s FROM b WINDOW w AS (PARTITION BY query_id ORDER BY ord)), o AS (SELECT *, max(CASE WHEN ord > 1 AND s > 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY ord) AS over_ FROM c) SELECT query_id, chunk_id FROM o WHERE over_ = 0""")
def evidence_budget(spark, d):
    blocks = pool(spark, d).select("query_id", "chunk_id", "ord", F.size(F.split("content", " ")).alias("n_tokens"))
    return V.within_budget(blocks, 3000).select("query_id", "chunk_id")


@query("""WITH r AS (SELECT CAST(CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id END AS VARCHAR) AS id, upper(lang) AS language, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS question, CASE WHEN doc_id % 5 = 0 THEN 'unanswerable' ELSE 'factual' END AS t, doc_id % 7 > 0 AS chunks, CASE WHEN doc_id % 11 > 0 THEN 'd' ELSE '' END AS document, doc_id % 17 > 0 AS pages, doc_id % 19 > 0 AS points FROM documents),
v AS (SELECT id, unnest([CASE WHEN coalesce(question, '') = '' THEN 'empty_question' END, CASE WHEN coalesce(language NOT IN ('EN', 'DE', 'FR', 'IT', 'ES'), true) THEN 'unknown_language' END, CASE WHEN t = 'unanswerable' AND chunks THEN 'unanswerable_with_chunks' END, CASE WHEN t <> 'unanswerable' AND NOT chunks THEN 'answerable_without_chunks' END,
CASE WHEN t <> 'unanswerable' AND document = '' THEN 'answerable_without_document' END, CASE WHEN t <> 'unanswerable' AND NOT pages THEN 'answerable_without_pages' END, CASE WHEN t <> 'unanswerable' AND NOT points THEN 'answerable_without_points' END]) AS violation FROM r)
SELECT violation, id FROM v WHERE violation IS NOT NULL UNION ALL SELECT 'duplicate_id', id FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'too_few_of_language', language FROM r WHERE t <> 'unanswerable' GROUP BY language HAVING count(*) < 90 UNION ALL SELECT 'too_few_records', NULL FROM r HAVING count(*) < 25""")
def dataset_violations(spark, d):
    i = F.col("doc_id")
    some = lambda c, kind: F.when(c, F.array(F.lit("1").cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    rows = table(spark, d, "documents").select(
        F.when(i % 97 == 0, 0).otherwise(i).cast("string").alias("id"), F.upper("lang").alias("language"), F.when(i % 13 == 0, "").otherwise(F.col("text")).alias("question"), F.when(i % 5 == 0, "unanswerable").otherwise("factual").alias("question_type"),
        some(i % 7 > 0, "string").alias("chunk_ids"), F.when(i % 11 > 0, "d").otherwise("").alias("document"), some(i % 17 > 0, "int").alias("pages"), some(i % 19 > 0, "string").alias("points"),
    )
    return V.dataset_violations(rows, 25, 90)


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 100")
def benchmark_subset(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.col("lang").alias("language"))
    return V.subset(rows, ["en", "de"], 100).select("doc_id")


@query("""WITH t AS (SELECT item_id, list_slice(list_filter(regexp_split_to_array(lower(text), '[^a-z%_]+'), lambda x: length(x) >= 3), 1, 2) || [lower('Zq' || item_id || '%')] AS terms FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, ['zzqq%', 'x_y' || item_id] FROM benchmark WHERE item_id % 2 = 1)
SELECT item_id AS id FROM t WHERE NOT EXISTS (SELECT 1 FROM documents, (SELECT unnest(t.terms) AS term) u WHERE contains(lower(documents.text), u.term))""")
def absent_probes(spark, d):
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z%_]+"), lambda x: F.length(x) >= 3), 1, 2)
    i = F.col("item_id")
    terms = F.when(i % 2 == 0, F.concat(words, F.array(F.concat(F.lit("Zq"), i.cast("string"), F.lit("%"))))).otherwise(F.array(F.lit("zzqq%"), F.concat(F.lit("x_y"), i.cast("string"))))
    return V.absent_terms(table(spark, d, "benchmark").select(i.alias("id"), terms.alias("terms")), table(spark, d, "documents").select(F.col("text").alias("content"))).select("id")


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 200")
def substantive_chunks(spark, d):
    return V.substantive(table(spark, d, "documents").withColumnRenamed("text", "content")).select("doc_id")


@query("""WITH c AS (SELECT doc_id // 30 AS document_id, upper(lang) AS language, doc_id AS chunk_id, row_number() OVER (PARTITION BY upper(lang), doc_id // 30 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY upper(lang), doc_id // 30) AS n FROM documents WHERE lang IN ('en', 'de')),
k AS (SELECT language, document_id, max(n) AS n FROM c GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY document_id) - 1 AS d, count(*) OVER (PARTITION BY language) AS docs FROM k),
t AS (SELECT DISTINCT language, docs, a AS attempt FROM m, range(0, 12) r(a) WHERE docs >= 2)
SELECT t.language, t.attempt::INTEGER AS attempt, c1.chunk_id AS first, c2.chunk_id AS second FROM t JOIN m m1 ON m1.language = t.language AND m1.d = t.attempt % t.docs JOIN m m2 ON m2.language = t.language AND m2.d = (t.attempt + 1) % t.docs
JOIN c c1 ON c1.language = t.language AND c1.document_id = m1.document_id AND c1.i = floor((t.attempt / 12.0::DOUBLE * m1.n) % m1.n) JOIN c c2 ON c2.language = t.language AND c2.document_id = m2.document_id AND c2.i = floor(((t.attempt + 0.5) / 12.0::DOUBLE * m2.n) % m2.n)""")
def multi_hop_pairs(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").where("lang in ('en', 'de')").select(F.floor(i / 30).alias("document_id"), F.upper("lang").alias("language"), i.alias("ord"), i.alias("chunk_id"))
    return V.multi_hop_pairs(rows)


@query("""WITH t AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || '😀b' ELSE text END AS t FROM benchmark),
u AS (SELECT item_id, flatten(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)) AS u FROM t),
h AS (SELECT item_id, CASE WHEN len(u) = 0 THEN 0 ELSE list_reduce(list_transform(u, lambda c: c::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) END AS h FROM u) SELECT item_id, h AS hash, 5 + h % 16 AS picked FROM h""")
def rolling_hash(spark, d):
    t = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("😀b"))).otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", V.rolling_hash(t).alias("hash"), V.picked(t, 5, 20).alias("picked"))


@query()
def entity_terms(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("q"), F.upper("lang").alias("language"))
    return rows.select("doc_id", V.entity_terms(F.col("q"), F.col("language")).alias("t")).select("doc_id", F.array_join("t", "|").alias("terms"))


@query()
def entity_grounding(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", V.entity_terms(F.col("text"), F.upper("lang")).alias("t"), F.substring("text", F.lit(200), F.length("text")).alias("e"))
    return rows.select("doc_id", F.size("t").alias("n_terms"), F.size(V.missing_terms(F.col("t"), F.col("e"))).alias("n_missing"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(quantile_cont(value, 0.9), 6) AS p90_linear FROM events GROUP BY 1""")
def percentiles(spark, d):
    return A.percentile_table(table(spark, d, "events"), "value", "event_type", {"p50": 0.5, "p95": 0.95}, {"p90_linear": 0.9}).withColumn("p90_linear", F.round("p90_linear", 6))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM r WHERE r = floor((n - 1) * 0.95)""")
def percentile_floor(spark, d):
    return A.floor_rank(table(spark, d, "events"), "value", 0.95, "event_type")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM r WHERE r = n // 2""")
def median_upper(spark, d):
    return A.at_ranks(table(spark, d, "events"), "value", "event_type", F.array(F.floor(F.col("n") / 2))).select("event_type", "value")


SNAPSHOT = """n AS (SELECT CAST(label AS VARCHAR) AS grp, length(embedding) AS dim, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"""


@query(f"""WITH {SNAPSHOT} SELECT grp, count(*) AS n, CAST(max(dim) AS INTEGER) AS dim, count(*) FILTER (norm = 0) AS zero, count(*) FILTER (norm < 1e-6) AS near_zero, round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std FROM n GROUP BY ROLLUP (grp)""")
def drift_snapshot(spark, d):
    return A.snapshot(table(spark, d, "embeddings"), "label")


@query(f"""WITH {SNAPSHOT}, u AS (SELECT CAST(label AS VARCHAR) AS grp, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT grp, pos, avg(x::DOUBLE) AS m FROM u GROUP BY GROUPING SETS ((grp, pos), (pos))),
c AS (SELECT grp, round(sqrt(sum(m * m)), 6) AS centroid_norm FROM m GROUP BY 1), s AS (SELECT grp, count(*) AS n, CAST(max(dim) AS INTEGER) AS dim FROM n GROUP BY ROLLUP (grp)), p AS (SELECT norm, row_number() OVER (ORDER BY norm) - 1 AS r, count(*) OVER () AS k FROM n)
SELECT s.grp, s.n, s.dim, CASE WHEN s.grp IS NULL THEN (SELECT round(norm, 6) FROM p WHERE r = floor((k - 1) * 0.95)) END AS norm_p95, centroid_norm FROM s JOIN c ON c.grp IS NOT DISTINCT FROM s.grp""")
def embedding_snapshot(spark, d):
    s = A.embedding_snapshot(table(spark, d, "embeddings"), "label")
    return s.select("grp", "n", "dim", "norm_p95", F.round(F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("centroid_norm"))


def _half(odd: str) -> str:
    return f"(SELECT CAST(label AS VARCHAR) AS grp, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings WHERE vec_id % 2 = {odd})"


def _stats(name: str, odd: str) -> str:
    u = f"{name}u AS (SELECT grp, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM {_half(odd)})"
    m = f"{name}m AS (SELECT grp, pos, avg(x) AS m FROM {name}u GROUP BY GROUPING SETS ((grp, pos), (pos)))"
    return f"{u}, {m}, {name}c AS (SELECT grp, list(m ORDER BY pos) AS c FROM {name}m GROUP BY 1), {name} AS (SELECT s.*, c FROM (SELECT grp, count(*) AS n, max(len(e)) AS dim, count(*) FILTER (norm = 0) AS zero, count(*) FILTER (norm < 1e-6) AS near, round(avg(norm), 6) AS mean, round(stddev_pop(norm), 6) AS sd FROM {_half(odd)} GROUP BY ROLLUP (grp)) s JOIN {name}c ON {name}c.grp IS NOT DISTINCT FROM s.grp)"


@query(f"""WITH {_stats('a', '0')}, {_stats('b', '1')}, o AS (SELECT a.n, a.zero, a.near, a.dim AS dim, b.dim AS bdim, CASE WHEN b.mean = 0 THEN CASE WHEN a.mean = 0 THEN 0 ELSE 1 END ELSE abs(a.mean - b.mean) / b.mean END AS dm, CASE WHEN b.sd = 0 THEN CASE WHEN a.sd = 0 THEN 0 ELSE 1 END ELSE abs(a.sd - b.sd) / b.sd END AS ds, 1 - list_cosine_similarity(a.c, b.c) AS dist FROM a, b WHERE a.grp IS NULL AND b.grp IS NULL)
SELECT 'sample_size_sufficient' AS name, n >= 100 AS passed FROM o UNION ALL SELECT 'zero_vectors_absent', zero / n <= 0 FROM o UNION ALL SELECT 'near_zero_vectors_within_limit', near / n <= 0.01 FROM o UNION ALL SELECT 'embedding_dimension_consistent', dim = bdim FROM o
UNION ALL SELECT 'norm_mean_drift_within_limit', dm <= 0.15 FROM o UNION ALL SELECT 'norm_stddev_drift_within_limit', ds <= 0.25 FROM o UNION ALL SELECT 'centroid_drift_within_limit', dist <= 0.08 FROM o
UNION ALL SELECT 'language_' || a.grp || '_centroid_drift_within_limit', 1 - list_cosine_similarity(a.c, b.c) <= 0.12 FROM a JOIN b ON a.grp = b.grp WHERE a.grp IN ('0', '1', '2', '3') AND least(a.n, b.n) >= 25""")
def drift_checks(spark, d):
    e = table(spark, d, "embeddings")
    half = lambda odd: A.embedding_snapshot(e.where(F.col("vec_id") % 2 == odd), "label")
    return A.drift_checks(half(0), half(1), ("0", "1", "2", "3"))


@query("""WITH s AS (SELECT status, updated_at, locked_at, CASE WHEN id % 50 = 0 THEN 'ERROR: Duplicate key value violates unique constraint "x"' END AS last_error, CASE WHEN id % 3 > 0 THEN id % 5000 END AS ms FROM jobs), w AS (SELECT *, updated_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AS recent, updated_at >= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 48 HOUR AND updated_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 24 HOUR AS before FROM s)
SELECT count(*) FILTER (status = 'completed' AND recent) AS completed, count(*) FILTER (status = 'processing' AND (locked_at IS NULL OR locked_at <= TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 900 SECOND)) AS stuck, count(*) FILTER (status = 'dead_letter' AND recent) AS dead_now, count(*) FILTER (status = 'dead_letter' AND before) AS dead_before,
count(*) FILTER (recent AND regexp_matches(last_error, '(?i)duplicate key value violates unique constraint')) AS duplicate_writes, quantile_disc(CASE WHEN status = 'completed' AND recent AND ms > 0 THEN ms END, 0.95) AS p95_completion_ms, dead_now - dead_before AS dead_growth FROM w""".replace("WITH s AS", "WITH " + C.JOBS + ", s AS", 1))
def soak_window(spark, d):
    i = F.col("id")
    rows = jobs(spark, d).withColumns({"last_error": F.when(i % 50 == 0, 'ERROR: Duplicate key value violates unique constraint "x"'), "processing_duration_ms": F.when(i % 3 > 0, i % 5000)})
    return A.soak(rows, C.MID)


@query("""SELECT unnest(['queue_backlog_within_limit', 'stale_processing_jobs_absent', 'processing_jobs_heartbeating_recently', 'cron_progress_present_when_queue_exists', 'processing_documents_match_active_jobs', 'ready_documents_have_chunks', 'processing_jobs_have_locks', 'non_processing_jobs_are_unlocked']) AS name,
unnest([s.queued_count <= 50, s.stale_processing_count = 0, s.lagging_processing_count = 0, s.queued_count = 0 OR s.recent_progress_count > 0, s.inconsistent_document_count = 0, s.ready_without_chunks_count = 0, s.processing_without_lock_count = 0, s.non_processing_with_lock_count = 0]) AS passed FROM (""" + C.SQL["runtime_snapshot"] + ") s")
def health_checks(spark, d):
    return A.health_checks(Q.runtime_snapshot(jobs(spark, d), C.effective(spark, d), C.cache(spark, d), C.MID))


@query("""WITH k AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS m FROM orders GROUP BY 1) SELECT sha256(string_agg(c_custkey || ':' || coalesce(n, 0) || ':' || coalesce(strftime(m, '%Y-%m-%dT%H:%M:%S'), 'none'), chr(10) ORDER BY c_custkey)) AS fingerprint FROM customer LEFT JOIN k ON o_custkey = c_custkey WHERE c_acctbal > 0""")
def corpus_fingerprint(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("queued").alias("status"))
    return A.corpus_fingerprint(docs, table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at")))


@query("SELECT l_orderkey AS query_id, sum(l_linenumber)::BIGINT AS vector, sum(l_partkey)::BIGINT AS keyword, sum(l_suppkey)::BIGINT AS fused, count(*) AS reranked FROM lineitem GROUP BY 1")
def merged_counts(spark, d):
    return A.merged_counts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("vector"), F.col("l_partkey").alias("keyword"), F.col("l_suppkey").alias("fused"), F.lit(1).cast("long").alias("reranked")))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), k AS (SELECT *, least(10, greatest(3, (n + 5) // 6)) AS k FROM r)
SELECT source, doc_id FROM k WHERE r IN (SELECT unnest(list_transform(range(k), lambda i: i * n // k)))""")
def even_sample(spark, d):
    return A.even_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query(f"""WITH e AS (SELECT event_type, ts, TIMESTAMP '{NOW}' AS now FROM events) SELECT event_type, count(*) FILTER (ts > now - INTERVAL 7 DAY AND ts <= now) AS current,
count(*) FILTER (ts > now - INTERVAL 14 DAY AND ts <= now - INTERVAL 7 DAY) AS previous, current - previous AS growth FROM e GROUP BY 1""")
def soak_growth(spark, d):
    return A.growth(table(spark, d, "events"), NOW)


@query(r"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
b AS (SELECT conv_id, turn, unnest(l) AS x, unnest(range(len(l)))::INTEGER AS block FROM p),
k AS (SELECT *, CASE WHEN regexp_matches(x, '^[-*•]\s+.+') THEN 'bullet' WHEN regexp_matches(x, '^\d+[.)]\s+.+') THEN 'numbered' WHEN length(x) < 80 AND NOT x LIKE '%.' AND NOT contains(x, chr(10)) AND len(string_split(x, ' ')) <= 10 THEN 'subheading' ELSE 'body' END AS kind FROM b)
SELECT conv_id, turn, block, kind, CASE WHEN kind = 'numbered' THEN regexp_extract(x, '^(\d+)', 1) END AS number, CASE kind WHEN 'bullet' THEN regexp_extract(x, '^[-*•]\s+(.+)', 1) WHEN 'numbered' THEN regexp_extract(x, '^\d+[.)]\s+(.+)', 1) ELSE x END AS content FROM k""")
def answer_blocks(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(W.answer_blocks(F.col("text"))).alias("block", "_b"))
    return rows.select("conv_id", "turn", "block", "_b.kind", "_b.number", "_b.content")


@query("SELECT event_id, coalesce(CASE WHEN isnan(v) THEN NULL ELSE v END, 0) AS v FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 'nan'::DOUBLE END AS v FROM events)")
def safe_numbers(spark, d):
    i = F.col("event_id")
    v = F.when(i % 3 == 0, F.col("value")).when(i % 3 == 1, F.lit(float("nan")))
    return table(spark, d, "events").select("event_id", T.numbers(v).alias("v"))


@query("SELECT o_custkey AS owner, count(DISTINCT o_orderpriority) AS kinds, (SELECT count(DISTINCT o_custkey) FROM orders) AS owners FROM orders GROUP BY 1")
def distinct_counts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("owner")).agg(F.countDistinct("o_orderpriority").alias("kinds")).crossJoin(o.agg(F.countDistinct("o_custkey").alias("owners")))  # one row


@query("SELECT c_custkey, n_name, coalesce(n_regionkey, -1) AS region, (SELECT max(o_orderdate) FROM orders) AS newest FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def scalar_attach(spark, d):
    newest = table(spark, d, "orders").agg(F.max("o_orderdate").alias("newest"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    rows = table(spark, d, "customer").join(n, "c_nationkey", "left")
    return rows.join(newest, F.lit(True), "left").select("c_custkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("region"), "newest")


@query("SELECT o_orderkey AS chunk_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_custkey IN (SELECT event_id FROM events) AND o_orderpriority = '1-URGENT'")
def scoped_chunks(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_acctbal") > 0, "ready").otherwise("failed").alias("status"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("language"))
    return R.scoped(chunks, docs, table(spark, d, "events").select(F.col("event_id").alias("document_id")), "1-URGENT").select("chunk_id")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), s AS (SELECT *, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (ORDER BY window_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM w) SELECT window_start, n FROM s WHERE s = 2""")
def metric_alerts(spark, d):
    return alerts(metric_windows(table(spark, d, "events")), "error", 1, 2).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(r"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text || '  ', '(?s).*?[.!?][)"''»\]]*\s+') AS l, text FROM conversations WHERE text IS NOT NULL), q AS (SELECT conv_id, turn, l, substr(text, 1 + coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT) AS rest, text FROM p),
s AS (SELECT conv_id * 1000 + turn AS answer_id, list_filter(list_append(l, rest), lambda x: trim(x) <> '') AS l FROM q) SELECT answer_id, unnest(range(len(l)))::INTEGER AS n, rtrim(unnest(l), ' ' || chr(9) || chr(10) || chr(13)) AS sentence FROM s""")
def answer_sentences(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    halves = F.array(F.struct(F.lit(0).alias("seq"), F.left("text", F.lit(40)).alias("delta")), F.struct(F.lit(1).alias("seq"), F.substring("text", F.lit(41), F.length("text")).alias("delta")))
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.inline(halves))
    return sentences(rows).withColumn("sentence", F.regexp_replace("sentence", r"\s+$", ""))


@query("SELECT conv_id * 1000 + turn AS query_id, len(list_filter(regexp_split_to_array(text, '\\s'), lambda x: true)) + 3 AS most, 'meta' AS first FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\s$')")
def answer_events(spark, d):
    c = table(spark, d, "conversations").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"\s$"))
    rows = W.event_rows(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("answer"), F.lit("answered").alias("outcome")))
    return rows.groupBy("query_id").agg(F.count("*").alias("most"), F.min_by("event", "seq").alias("first"))
