"""Retrieval and answering for a batch of queries: every step is one plan over all queries, keyed by query_id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import safety as G
from siftline.functions import text as X
from siftline.operators import answers as W
from siftline.operators import evaluation as V
from siftline.operators import evidence as E
from siftline.operators import keyword_index as N
from siftline.operators import ranking as R
from siftline.providers import Providers
from siftline.sources.shared import kept

BODY = ("document_id", "page", "title", "content", "context", "language")


@dataclass(frozen=True)
class Config:
    """Settings of retrieval and answering, with the defaults of production."""

    top_k: int = 8
    pool: int = 100
    rrf_k: int = 60
    cross_encoder: bool = True
    encoder_context: bool = False
    grouping: bool = True
    boost: float = 0.05
    per_document: int = 0
    floor: float = 0.25
    variations: int = 3
    sub_queries: int = 3
    hyde: bool = True
    least_chunks: int = 2
    encoder_threshold: float = 0.25
    heuristic_threshold: float = 0.14
    top3: float = 0.3
    top3_heuristic: float = 0.14
    loop: bool = False
    guard: bool = True
    least_web: int = 2
    pii: str = "numbers_safe"

    def fingerprint(self) -> str:
        return X.config_fingerprint({"ce": self.cross_encoder, "cectx": self.encoder_context, "pool": self.pool, "rrfk": self.rrf_k, "group": self.grouping, "adjb": self.boost, "maxdoc": self.per_document, "divfloor": self.floor})


def prepared(queries: DataFrame) -> DataFrame:
    """queries (query_id, text, and hint if given) with query, normalised, and query_language."""
    q = queries.withColumn("query", X.normalize_query(F.col("text")))
    return q.withColumn("query_language", X.query_language(F.col("query"), F.col("hint") if "hint" in queries.columns else None))


def ordered(rows: DataFrame, top_k: int, config: Config, providers: Providers) -> DataFrame:
    """Scored rows of each query to its final list: heuristic rerank of the pool, cross-encoder, grouping, diversity, cut."""
    rows = R.heuristic_rerank(R.text_features(rows), config.pool).withColumn("scale", F.lit("heuristic"))
    if config.cross_encoder and providers.reranker is not None:
        text = R.encoder_text(F.coalesce("title", F.lit("")), F.col("context"), F.coalesce("content", F.lit("")), config.encoder_context)
        rows = R.cross_encoder(rows, F.round(providers.reranker.score(F.col("query"), text), 9))
    if config.grouping:
        grouped = R.adjacency_boost(rows.withColumn("retrieval", F.col("score")).withColumn("score", F.coalesce("rerank_score", "score")), config.boost)
        rows = grouped.withColumn("rerank_score", F.col("boosted")).drop("boosted", "score").withColumnRenamed("retrieval", "score")
    if config.per_document > 0:
        rows = R.diversify(rows, top_k, config.per_document, config.floor).drop("ord").withColumnRenamed("place", "ord")
    return rows.where(F.col("ord") <= top_k)


def candidates(queries: DataFrame, chunks: DataFrame, limit: int, config: Config, providers: Providers) -> DataFrame:
    """The fused candidates of prepared queries with the bodies of their chunks."""
    vectors = queries.select("query_id", F.col("embedding") if "embedding" in queries.columns else providers.embedding.embed(F.col("query")).alias("embedding"))
    near = R.vector_topk(vectors, chunks.select("chunk_id", "embedding"), limit)
    words = N.keyword_search(queries.select("query_id", F.col("query").alias("text")), chunks, limit)
    return R.rrf(near, words, config.rrf_k).join(chunks.select("chunk_id", *BODY), "chunk_id").join(queries.select("query_id", "query", "query_language"), "query_id")


def retrieve(queries: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None, top_k: int | None = None) -> DataFrame:
    """The ranked chunks of each query: (query_id, chunk_id, ord, score, rerank_score, relevance, scale, source, similarity, and
    the chunk's body). queries: (query_id, text); chunks: (chunk_id, document_id, page, title, content, context, language,
    embedding). Chunks that may not be seen are left out before."""
    config, providers = config or Config(), providers or Providers()
    top_k = top_k or config.top_k
    found = candidates(prepared(queries), chunks, R.candidate_limit(top_k, config.pool), config, providers)
    return ordered(found, top_k, config, providers)


def counts(rows: DataFrame) -> DataFrame:
    """(query_id, vector, keyword, fused): how many candidates each search gave."""
    v, k = F.col("vector_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    return rows.groupBy("query_id").agg(F.count_if(v).alias("vector"), F.count_if(k).alias("keyword"), F.count("*").alias("fused"))


def overview(queries: DataFrame, chunks: DataFrame, top_k: int = 8) -> DataFrame:
    """For queries (query_id, text, scope) that ask for an overview of the one document in their scope: representative chunks."""
    asked = prepared(queries).where(X.overview_intent(F.col("query"), F.col("scope"))).select("query_id", F.get("scope", 0).alias("document_id"))
    rows = chunks.join(asked.select("document_id").distinct(), "document_id", "left_semi")
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "chunk_id")) - 1)
    picked = R.overview(rows.select("document_id", "chunk_id", "ord", "content", "context"), top_k)
    return asked.join(picked, "document_id").select("query_id", "document_id", "chunk_id", "score", "content")


def _branches(queries: DataFrame, texts: Column, kinds: Column) -> DataFrame:
    """A row for each branch of a query: branch, kind, weight, and a query_id of its own."""
    rows = queries.select(F.col("query_id").alias("main"), "query_language", F.posexplode(F.arrays_zip(texts.alias("text"), kinds.alias("kind"))).alias("branch", "_b"))
    weight = F.when(F.col("_b.kind") == "base", 1.0).when(F.col("_b.kind") == "hyde", 0.75).otherwise(0.9)
    return rows.select((F.col("main") * 100 + F.col("branch")).alias("query_id"), "main", "branch", F.col("_b.kind").alias("kind"), weight.alias("weight"), F.col("_b.text").alias("text"), F.col("query_language").alias("hint"))


def _gathered(branches: DataFrame, found: DataFrame, k: int) -> DataFrame:
    lists = found.join(branches.select("query_id", "main", "branch", "weight"), "query_id").drop("query_id").withColumnRenamed("main", "query_id")
    fused = R.weighted_fusion(lists.select("query_id", "chunk_id", "branch", "weight", "ord"), k)
    return lists, fused


def expand(queries: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None) -> DataFrame:
    """Retrieval with variations and a hypothetical passage as branches of each query: all branches are searched in one plan,
    fused by weighted ranks and ordered like a single list."""
    config, providers = config or Config(), providers or Providers()
    q, llm = prepared(queries), providers.llm
    varied = X.variations(llm.variations(F.col("query")), F.col("query"), config.variations)
    passage = F.array(llm.passage(F.col("query"))) if config.hyde else F.array().cast("array<string>")
    kinds = F.concat(F.transform(varied, lambda x, i: F.when(i == 0, F.lit("base")).otherwise(F.lit("variation"))), F.transform(passage, lambda x: F.lit("hyde")))
    branches = _branches(q, F.concat(varied, passage), kinds)
    each = max(config.top_k, min(config.pool, max(2 * config.top_k, 8)))
    lists, fused = _gathered(branches, kept(retrieve(branches.select("query_id", "text", "hint"), chunks, config, providers, each), "branch-lists"), config.rrf_k)
    return _expanded(q, chunks, lists, fused, config, providers)


def _expanded(q: DataFrame, chunks: DataFrame, lists: DataFrame, fused: DataFrame, config: Config, providers: Providers) -> DataFrame:
    """Fused branches ordered like a single list, each chunk with the similarity that its last branch gave it."""
    own = lists.select("query_id", "chunk_id", F.col("branch").alias("kept_branch"), "similarity")
    rows = fused.where(F.col("ord") <= max(config.pool, 4 * config.top_k)).join(own, ["query_id", "chunk_id", "kept_branch"])
    rows = rows.join(chunks.select("chunk_id", *BODY), "chunk_id").join(q.select("query_id", "query", "query_language"), "query_id")
    return ordered(rows, config.top_k, config, providers)


def decompose(queries: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None) -> DataFrame:
    """Retrieval with the parts of long questions (query_id, text, scope if given) as branches: fused by weighted ranks, each
    chunk as the branch has it where its relevance is best. Questions that are short, of one document or in one piece are
    retrieved as they are."""
    config, providers = config or Config(), providers or Providers()
    q = prepared(queries)
    eligible = X.decomposes(F.col("query")) & ((F.size("scope") != 1) if "scope" in queries.columns else F.lit(True))
    parts = F.when(eligible, X.sub_queries(providers.llm.sub_queries(F.col("query")), F.col("query"), config.sub_queries)).otherwise(F.array().cast("array<string>"))
    kinds = F.concat(F.array(F.lit("base")), F.transform(parts, lambda x: F.lit("variation")))
    branches = _branches(q, F.concat(F.array(F.col("query")), parts), kinds)
    lists, fused = _gathered(branches, kept(retrieve(branches.select("query_id", "text", "hint"), chunks, config, providers), "branch-lists"), config.rrf_k)
    return _merged(lists, fused, config)


def _merged(lists: DataFrame, fused: DataFrame, config: Config) -> DataFrame:
    """Fused branches in that order, each chunk as the branch has it where its relevance is best."""
    best = R.pool_merge(lists.withColumn("ord", F.col("branch") * 1000 + F.col("ord"))).drop("ord", "score", "branch", "weight")
    rows = fused.drop("kept_branch").join(best, ["query_id", "chunk_id"])
    if config.per_document > 0:
        rows = R.diversify(rows, config.top_k, config.per_document, config.floor).drop("ord").withColumnRenamed("place", "ord")
    return rows.where(F.col("ord") <= config.top_k)


@dataclass(frozen=True)
class Routed:
    """rows: as retrieve gives them; trace: (query_id, strategy, branches, variations, sub_queries, hyde, and the sums of the branches'
    candidate counts); failures: (query_id, branch, kind) of the branches that gave nothing because their embedding failed."""

    rows: DataFrame
    trace: DataFrame
    failures: DataFrame


def route(queries: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None) -> Routed:
    """Retrieval of a mixed batch: queries (query_id, text, expand, and scope if given) that ask for expansion go by variations and
    a hypothetical passage, long ones on several documents by their parts, all others as they are.

    The branches of all queries are rows of one table. A branch whose embedding is null has failed: it is a row of failures,
    and its query goes on with the others; a query whose own text fails has no rows."""
    config, providers = config or Config(), providers or Providers()
    q, llm, none = prepared(queries), providers.llm, F.array().cast("array<string>")
    wide = F.coalesce("expand", F.lit(False))
    parted = X.decomposes(F.col("query")) & ~wide & ((F.coalesce(F.size("scope"), F.lit(0)) != 1) if "scope" in queries.columns else F.lit(True))
    varied = F.slice(X.variations(llm.variations(F.col("query")), F.col("query"), config.variations), 2, config.variations)
    parts = X.sub_queries(llm.sub_queries(F.col("query")), F.col("query"), config.sub_queries)
    q = q.withColumns({"_more": F.when(wide, varied).when(parted, parts).otherwise(none), "_hyde": F.when(wide & F.lit(config.hyde), F.array(llm.passage(F.col("query")))).otherwise(none)})
    strategy = F.when(wide, "query_expansion").when(F.size("_more") > 0, "query_decomposition").otherwise("standard")
    q = kept(q.withColumn("strategy", strategy), "routed")
    kinds = F.concat(F.array(F.lit("base")), F.transform("_more", lambda x: F.lit("variation")), F.transform("_hyde", lambda x: F.lit("hyde")))
    branches = _branches(q, F.concat(F.array(F.col("query")), "_more", "_hyde"), kinds).join(q.select(F.col("query_id").alias("main"), "strategy"), "main")
    branches = kept(prepared(branches).withColumn("embedding", providers.embedding.embed(F.col("query"))), "branches")
    failures = branches.where("embedding is null")
    good = branches.where("embedding is not null").join(failures.where("kind = 'base'").select("main"), "main", "left_anti")
    each = max(config.top_k, min(config.pool, max(2 * config.top_k, 8)))
    shown = ("query_id", "text", "hint", "embedding")
    expanding = F.col("strategy") == "query_expansion"

    def found(some: DataFrame, k: int) -> DataFrame:
        fused = candidates(prepared(some.select(*shown)), chunks, R.candidate_limit(k, config.pool), config, providers)
        return kept(fused, "branch-candidates")

    wide_pool, plain_pool = found(good.where(expanding), each), found(good.where(~expanding), config.top_k)
    columns = None
    lists = []
    for pool, k in ((wide_pool, each), (plain_pool, config.top_k)):
        got = ordered(pool, k, config, providers)
        columns = columns or got.columns
        lists.append(kept(got.select(columns), "branch-lists"))
    wide_lists, wide_fused = _gathered(good, lists[0], config.rrf_k)
    plain_lists, plain_fused = _gathered(good.where("strategy = 'query_decomposition'"), lists[1], config.rrf_k)
    own = good.where("strategy = 'standard'").select("query_id", "main")
    alone = lists[1].join(own, "query_id").drop("query_id").withColumnRenamed("main", "query_id")
    shapes = [_expanded(q, chunks, wide_lists, wide_fused, config, providers), _merged(plain_lists, plain_fused, config), alone]
    common = [c for c in shapes[2].columns if all(c in x.columns for x in shapes)]
    rows = shapes[0].select(common).unionByName(shapes[1].select(common)).unionByName(shapes[2].select(common))
    summed = counts(wide_pool.select("query_id", "vector_rank", "keyword_rank").unionByName(plain_pool.select("query_id", "vector_rank", "keyword_rank")))
    summed = summed.join(branches.select("query_id", "main"), "query_id").groupBy(F.col("main").alias("query_id")).agg(*(F.sum(c).alias(c) for c in ("vector", "keyword", "fused")))
    trace = q.select("query_id", "strategy", (1 + F.size("_more") + F.size("_hyde")).alias("branches"), F.when(expanding, F.size("_more")).otherwise(0).alias("variations"), F.when(expanding, 0).otherwise(F.size("_more")).alias("sub_queries"), (F.size("_hyde") > 0).alias("hyde"))
    return Routed(rows, trace.join(summed, "query_id", "left").na.fill(0, ["vector", "keyword", "fused"]), failures.select(F.col("main").alias("query_id"), "branch", "kind"))


def correct(queries: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None) -> DataFrame:
    """A second retrieval for each query and its variations, merged by best relevance, without fusion or cut."""
    config, providers = config or Config(), providers or Providers()
    q = prepared(queries)
    varied = X.variations(providers.llm.variations(F.col("query")), F.col("query"), config.variations)
    branches = _branches(q, varied, F.transform(varied, lambda x, i: F.when(i == 0, F.lit("base")).otherwise(F.lit("variation"))))
    found = retrieve(branches.select("query_id", "text", "hint"), chunks, config, providers)
    lists = found.join(branches.select("query_id", "main", "branch"), "query_id").drop("query_id").withColumnRenamed("main", "query_id")
    return R.pool_merge(lists.withColumn("ord", F.col("branch") * 1000 + F.col("ord"))).drop("branch")


def answer(queries: DataFrame, retrieved: DataFrame, config: Config | None = None, providers: Providers | None = None, corrected: DataFrame | None = None, web: DataFrame | None = None) -> DataFrame:
    """(query_id, answer, outcome, cited, citations, invalid, fell_back, reasons, n_redacted, suspicious, blocked, verdict, checked,
    unsupported): a grounded answer to each of queries (query_id, text, and scope, document ids, if given) from retrieved chunks.

    Steps: protect the chunks, assess them (a question on one document needs one chunk), in the ambiguous band merge the
    corrected ones (if the loop is on) and caution the prompt about terms that the evidence lacks, order for the prompt, generate,
    then abstention, leak, citations, output filter, verification and reflection. A refusal's outcome names its reason;
    its citations are the first three of what was found, an answer's those it cites. What was retrieved is written once.

    web: sources (query_id, ord, title, url, snippet) of the questions that are researched on the web. Those go on without
    sufficient chunks if they have config.least_web sources, and then without the chunks below their threshold; the corrective
    loop, the caution and reflection don't apply to them. n_web, suspicious_web and blocked_web are counts of sources."""
    config, providers = config or Config(), providers or Providers()
    q = kept(prepared(queries), "questions")
    retrieved = kept(retrieved, "retrieved")
    rank = F.coalesce("rerank_score", "score")
    one_document = queries.select("query_id", (F.size("scope") == 1).alias("_one")) if "scope" in queries.columns else None

    def shown(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        safe = E.protect(rows.withColumn("_raw", F.col("content")))
        scored = safe.select("query_id", "ord", "relevance", "scale")
        scored = scored if one_document is None else scored.join(one_document, "query_id", "left")
        verdicts = E.assess(scored, config.least_chunks, config.encoder_threshold, config.heuristic_threshold, config.top3, config.top3_heuristic, None if one_document is None else F.coalesce("_one", F.lit(False)))
        return safe, verdicts

    safe, verdicts = shown(retrieved)
    pages = None if web is None else kept(E.web_evidence(E.protect_web(web)), "web")
    if config.loop and corrected is not None:
        weak = verdicts.where(E.corrects(F.col("verdict"))).select("query_id")
        weak = weak if pages is None else weak.join(pages.select("query_id"), "query_id", "left_anti")
        columns = [c for c in retrieved.columns if c in corrected.columns]
        more = corrected.join(weak, "query_id", "left_semi").select(columns).withColumn("ord", F.col("ord") + 100_000)
        pooled = R.pool_merge(retrieved.join(weak, "query_id", "left_semi").select(columns).unionByName(more))
        safe, verdicts = shown(retrieved.join(weak, "query_id", "left_anti").select(columns).unionByName(pooled.select(columns)))
    first_found = safe.where("ord <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))).alias("read"))
    if pages is not None:
        alone = verdicts.where("verdict = 'insufficient'").join(pages.where(F.col("n_web") >= max(1, config.least_web)).select("query_id"), "query_id", "left_semi").select("query_id", F.lit(True).alias("_alone"))
        fit = F.coalesce(F.col("relevance") >= E.by_scale(F.col("scale"), config.encoder_threshold, config.heuristic_threshold), F.lit(False))
        safe = safe.join(alone, "query_id", "left").where(F.col("_alone").isNull() | fit).drop("_alone")
    placed = R.evidence_order(safe.withColumn("retrieval", F.col("score")).withColumn("score", rank)).drop("ord").withColumnRenamed("place", "ord")
    prompts = E.prompt_evidence(placed)
    g = placed.groupBy("query_id").agg(
        F.count("*").cast("int").alias("n_evidence"), F.min_by("content", "ord").alias("first"), F.array_join(F.collect_list("content"), "\n").alias("all"), F.array_distinct(F.flatten(F.collect_list(G.emails(F.concat_ws("\n", "_raw", "context"))))).alias("emails"),
        F.count_if("suspicious").alias("suspicious"), F.count_if("blocked").alias("blocked"),
        F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))).alias("shown"),
    )
    j = q.join(g, "query_id", "left").join(prompts, "query_id", "left").join(verdicts.select("query_id", "verdict"), "query_id", "left").join(first_found, "query_id", "left")
    j = j.join(pages, "query_id", "left") if pages is not None else j.withColumns({"web": F.lit(None).cast("string"), **{c: F.lit(0).cast("long") for c in ("n_web", "suspicious_web", "blocked_web")}})
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_web", "suspicious_web", "blocked_web")}).withColumn("_web", F.col("n_web") > 0)
    j = j.withColumn("verdict", F.coalesce("verdict", F.lit("insufficient")))
    if config.loop and config.guard:
        missing = caution(queries, placed.select("query_id", "ord", "content", "context"))
        j = j.join(missing, "query_id", "left").withColumn("evidence", F.concat("evidence", F.when((F.col("verdict") == "ambiguous") & ~F.col("_web"), E.caution_block(F.col("missing"))).otherwise("")))
    whole = F.concat(F.coalesce("evidence", F.lit("(none)")), F.lit("\n\nWeb research sources:\n\n"), F.col("web"))
    j = j.withColumn("evidence", F.when(F.col("_web"), whole).otherwise(F.col("evidence")))
    j = j.withColumn("raw", providers.llm.answer(F.col("query"), F.col("evidence"), F.col("first")))
    cited = W.resolve_citations(F.col("raw"), F.coalesce("n_evidence", F.lit(0)))
    j = kept(j.withColumn("c", cited).withColumn("_text", X.nfkc(F.col("c.answer"))), "drafts")  # no Python behind this, and one generation
    j = j.withColumn("f", G.filter_output(F.col("_text"), F.col("query_language"), config.pii, F.coalesce("emails", F.array().cast("array<string>"))))
    checked = W.cited_sentences(F.col("f.answer"), F.coalesce("n_evidence", F.lit(0)))
    j = j.withColumn("s", checked).withColumn("checked", F.size("s")).withColumn("unsupported", F.size(F.filter("s", lambda x: ~providers.llm.supported(x.sentence, F.col("all")))))
    band = (F.col("verdict") == "ambiguous") & F.lit(config.loop) & ~F.col("_web")
    refused_at_once = (F.col("verdict") == "insufficient") & ~(F.col("_web") & (F.col("n_web") >= max(1, config.least_web)))
    outcome = (
        F.when(refused_at_once, "insufficient_evidence").when(E.abstains(F.col("raw")), "model_abstention").when(band & E.begins_abstaining(F.col("raw")), "model_abstention_prefix").when(G.leaks(F.col("raw")), "sensitive_leakage")
        .when(F.col("f.blocked"), "blocked").when(band & E.reflects(F.col("checked"), F.col("unsupported")), "reflection_unsupported_citations").otherwise("answered")
    )
    refusal = F.lit("I do not have enough evidence in the indexed documents to answer this confidently. Please refine your question or upload more relevant material.")
    given = F.col("outcome").isin("answered", "blocked")
    refused = F.transform(F.slice("read", 1, 3), lambda x: x.chunk_id)
    cites = F.coalesce(F.when(given, F.array_distinct(F.transform("c.cited", lambda i: F.get(F.col("shown"), i - 1).chunk_id))).otherwise(refused), F.array().cast("array<long>"))
    j = j.withColumn("outcome", outcome).withColumn("citations", cites)
    return j.select("query_id", F.when(given, F.col("f.answer")).otherwise(refusal).alias("answer"), "outcome", F.when(given, F.col("c.cited")).otherwise(F.array().cast("array<int>")).alias("cited"), "citations", F.col("c.invalid").alias("invalid"), F.col("c.fell_back").alias("fell_back"), F.col("f.reasons").alias("reasons"), F.col("f.n_redacted").alias("n_redacted"), F.coalesce("suspicious", F.lit(0)).alias("suspicious"), F.coalesce("blocked", F.lit(0)).alias("blocked"), "n_web", "suspicious_web", "blocked_web", "verdict", "checked", "unsupported")


def caution(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, missing): the terms of each query that its evidence doesn't show."""
    text = F.concat_ws("\n", F.coalesce("content", F.lit("")), F.coalesce("context", F.lit("")))
    seen = retrieved.select("query_id", "ord", text.alias("t")).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "t"))).t, "\n").alias("evidence"))
    q = prepared(queries).join(seen, "query_id", "left")
    return q.select("query_id", V.missing_terms(V.entity_terms(F.col("text"), F.col("query_language")), F.coalesce("evidence", F.lit(""))).alias("missing"))


def compact(rows: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Identity and scores of the first `most` rows of each list, and (query_id, n, omitted)."""
    kept = rows.where(F.col("ord") <= most).select("query_id", "ord", *(c for c in ("chunk_id", "document_id", "page", "title", "score", "rerank_score", "relevance", "scale") if c in rows.columns))
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.greatest(F.lit(0), F.count("*") - most).alias("omitted"))
    return kept, n


def memo_live(memo: DataFrame, now: str, most: int = 500) -> DataFrame:
    """The entries (key, expires_at, used_at) of a memo that haven't expired, the `most` used last."""
    return memo.where(F.col("expires_at") > F.lit(now).cast("timestamp")).orderBy(F.desc("used_at"), "key").limit(most)


def evaluated(golden: DataFrame, chunks: DataFrame, config: Config | None = None, providers: Providers | None = None) -> DataFrame:
    """The figures of golden queries (query_id, text, language, question_type, chunk_ids, document, section, pages, points), all
    run as one batch: recall, nDCG, rank, citations, grounding, abstention. See evaluation.summary for what they add up to."""
    config, providers = config or Config(), providers or Providers()
    found = kept(retrieve(golden.select("query_id", "text"), chunks, config, providers), "found").withColumnRenamed("title", "section")
    said = kept(answer(golden.select("query_id", "text"), found.withColumnRenamed("section", "title"), config, providers), "answers")
    ranks = V.retrieval(V.relevance(found.select("query_id", "ord", "chunk_id", "document_id", "page", "section"), golden), golden)
    cites = said.select("query_id", F.explode("cited").alias("ord")).join(found.select("query_id", "ord", "chunk_id", "document_id", "page"), ["query_id", "ord"])
    quality = V.citation_quality(cites.drop("ord"), golden)
    refused = F.col("outcome") != "answered"
    texts = said.join(golden.select("query_id", "points"), "query_id").select("query_id", "answer", "points", refused.alias("insufficient"))
    ground = V.grounding(texts, found.withColumnRenamed("section", "title"))
    out = golden.select("query_id", "language", "question_type").join(ranks, "query_id").join(quality, "query_id").join(ground, "query_id", "left")
    return out.join(said.select("query_id", refused.alias("insufficient"), "outcome"), "query_id", "left")
