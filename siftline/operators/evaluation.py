"""Evaluation of retrieval and answers against a golden set: relevance, citations, grounding, failures, summaries, gates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.columns import few, let
from siftline.operators import metrics as A

LANGUAGES = ("EN", "DE", "FR", "IT", "ES")
# Signs of an abstention, headings of limitations, and the release thresholds.
ABSTENTIONS = r"(?i)not enough evidence|insufficient evidence|nicht genug belege|preuves insuffisantes|prove insufficienti|evidencia insuficiente"
LIMITATIONS = r"(?i)^##\s+.*(limitation|limitación|limitacion|limitazion|limites|einschränkung|beschränkung|grenzen)"
THRESHOLDS = {
    "recallAt5": 0.85, "ndcgAt10": 0.8, "citationEvidenceHitRate": 0.8, "verifiedCitationRate": 0.9, "faithfulnessMin": 0.9, "falseAnswerRateMax": 0.1, "falseAbstentionRateMax": 0.05,
    "perLanguageRecallAt5": 0.85, "perLanguageNdcgAt10": 0.8, "perLanguageMinQueries": 5, "cacheHitRate": 0.3, "uncachedP50LatencyMs": 8000, "uncachedP95LatencyMs": 15000, "cachedP50LatencyMs": 7000, "cachedP95LatencyMs": 12000,
}


def normalised(x: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    """Runs of Latin letters and digits of two characters or more."""
    return F.filter(F.split(normalised(x), "[^a-z0-9À-ɏ]+"), lambda t: F.length(t) >= 2)


def relevance(results: DataFrame, golden: DataFrame, ignore_section: bool = False) -> DataFrame:
    """results (query_id, ord, chunk_id, document_id, page, section) with relevant, by golden (query_id, chunk_ids, document,
    section, pages): one of the chunk ids if there are any, else the document and a page of it, and a section that contains
    the expected one or is contained in it (an empty one fits)."""
    j = results.join(golden.select("query_id", "chunk_ids", "document", F.col("section").alias("_want"), "pages"), "query_id")
    want, got = normalised(F.coalesce("_want", F.lit(""))), normalised(F.coalesce("section", F.lit("")))
    fits = F.lit(True) if ignore_section else (want == "") | (got == "") | F.contains(got, want) | F.contains(want, got)
    placed = (F.col("document_id") == F.col("document")) & F.array_contains("pages", F.col("page")) & fits
    hit = F.when(F.size("chunk_ids") > 0, F.array_contains("chunk_ids", F.col("chunk_id"))).otherwise(placed)
    return j.withColumn("relevant", F.coalesce(hit, F.lit(False))).select(*results.columns, "relevant")


def retrieval(marked: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, recall_at_5, ndcg_at_10, mrr, first_rank) of every golden query, over its first ten results."""
    top = marked.where((F.col("ord") <= 10) & F.col("relevant"))
    g = top.groupBy("query_id").agg(F.min("ord").alias("first_rank"), F.sum(1 / F.log2(F.col("ord") + 1)).alias("_dcg"), F.count("*").alias("_found"))
    j = golden.select("query_id", F.when(F.size("chunk_ids") > 0, F.size("chunk_ids")).otherwise(F.size("pages")).alias("_n")).join(g, "query_id", "left")
    n = F.least(F.lit(10), F.greatest(F.lit(1), F.col("_n"), F.coalesce("_found", F.lit(0)).cast("int")))
    ideal = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return j.select("query_id", F.coalesce((F.col("first_rank") <= 5).cast("int"), F.lit(0)).alias("recall_at_5"), F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_at_10"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"), "first_rank")


def citation_quality(citations: DataFrame, golden: DataFrame) -> DataFrame:
    """(query_id, accuracy, evidence_hit) of every golden query, from citations (query_id, chunk_id, document_id, page)."""
    marked = relevance(citations.withColumn("section", F.lit("")), golden, ignore_section=True)
    g = marked.groupBy("query_id").agg(F.avg(F.col("relevant").cast("double")).alias("_a"), F.max(F.col("relevant").cast("int")).alias("_h"))
    return golden.select("query_id").join(g, "query_id", "left").select("query_id", F.round(F.coalesce("_a", F.lit(0.0)), 6).alias("accuracy"), F.coalesce("_h", F.lit(0)).alias("evidence_hit"))


def grounding(answers: DataFrame, chunks: DataFrame, share: float = 0.35) -> DataFrame:
    """(query_id, grounding, hallucination) of answers (query_id, answer, points, insufficient) on chunks (query_id, title,
    context, content): the share of statements that a point contains or is contained in, or of whose tokens enough occur in
    the chunks or points; null for an abstention, 0 without statements."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "context", "content")))
    said = answers.select("query_id", F.explode(F.col("points")).alias("_t"))
    corpus = chunks.select("query_id", text.alias("_t")).unionByName(said).select("query_id", F.explode(tokens(F.col("_t"))).alias("_w"))
    corpus = corpus.groupBy("query_id").agg(F.collect_set("_w").alias("_words"))  # of the few chunks of a query
    parts = F.filter(F.transform(F.split("answer", r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")

    def supported(s: Column) -> Column:
        told = F.exists("points", lambda p: let(normalised(p), lambda q: (q != "") & (F.contains(normalised(s), q) | F.contains(q, normalised(s)))))
        words = lambda t: (F.size(t) == 0) | (F.size(F.filter(t, lambda w: F.array_contains(F.col("_words"), w))) / F.size(t) >= share)
        return told | let(tokens(s), words)

    j = answers.join(corpus, "query_id", "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<string>"))).withColumn("_s", parts)
    score = F.when(F.size("_s") == 0, 0.0).otherwise(F.size(F.filter("_s", supported)) / F.size("_s"))
    abstained = F.col("insufficient") | F.col("answer").rlike(ABSTENTIONS)
    return j.select("query_id", F.when(~abstained, F.round(score, 6)).alias("grounding")).withColumn("hallucination", F.round(1 - F.col("grounding"), 6))


def without_limitations(answer: Column) -> Column:
    """The answer without its sections on limitations, each from its heading to the next one of the first two levels."""
    lines = F.split(answer, "\n")

    def step(acc: Column, x: Column) -> Column:
        head = x.rlike(r"^#{1,2}\s")
        skip = F.when(head, x.rlike(LIMITATIONS)).otherwise(acc.skip)
        return F.struct(skip.alias("skip"), F.when(skip, acc.kept).otherwise(F.concat(acc.kept, F.array(x))).alias("kept"))

    kept = F.aggregate(lines, F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept")), step, lambda acc: acc.kept)
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)\s+$", "")


def fraction(values: Column, expected: Column) -> Column:
    """The share of true ones in a judge's list; null if the list hasn't the expected length, or that is 0."""
    return F.when((expected > 0) & (F.size(values) == expected), F.size(F.filter(values, lambda v: v)) / expected)


def clamp(x: Column) -> Column:
    return F.when(~F.isnan(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def judged(rows: DataFrame) -> DataFrame:
    """What a judge's answer comes to: rows (query_id, statements, lists of what it holds supported; relevance; chunk_relevant and
    points_covered; n_chunks; n_points; insufficient) with judged, faithfulness, answer_relevance, context_precision,
    context_recall and unsupported. Without a statement nothing is unfaithful; a refusal has no relevance; a list of another length
    than what it judges gives null. Nulls among supported count as unsupported; a null list of statements is empty, and a
    null relevance and lists (no answer) judge nothing."""
    statements = F.coalesce("statements", F.array().cast("array<boolean>"))
    supported = F.size(F.filter(statements, lambda v: F.coalesce(v, F.lit(False))))
    answered = F.col("statements").isNotNull() | F.col("relevance").isNotNull()
    put = {
        "faithfulness": F.when(F.size(statements) == 0, 1.0).otherwise(supported / F.size(statements)), "answer_relevance": F.when(F.col("insufficient"), 0.0).otherwise(clamp(F.col("relevance"))),
        "context_precision": fraction(F.col("chunk_relevant"), F.col("n_chunks")), "context_recall": fraction(F.col("points_covered"), F.col("n_points")), "unsupported": F.size(statements) - supported,
    }
    return rows.select("query_id", answered.alias("judged"), *(F.when(answered, v).alias(k) for k, v in put.items()))


def within_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """Each query's blocks (query_id, ord, n_tokens) up to the first one that would exceed the budget; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("ord")
    sums = blocks.withColumn("_sum", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.row_number().over(w) == 1)
    over = F.max((~F.col("_first") & (F.col("_sum") > budget)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("_over", over).where("_over = 0").drop("_sum", "_first", "_over")


def failures(results: DataFrame) -> DataFrame:
    """(query_id, failure, n): what went wrong with each query; see summary for the columns of results."""
    t = THRESHOLDS
    answerable = F.col("question_type") != "unanswerable"
    when = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    kinds = F.array(
        when(F.col("insufficient") != ~answerable, "abstention"), when(answerable & (F.col("recall_at_5") < 1), "retrieval"),
        when(answerable & (F.col("citation_evidence_hit") < 1), "citation"), when(answerable & (F.col("verified_citation_rate") < t["verifiedCitationRate"]), "citation"),
        when(answerable & F.col("judged") & (F.col("faithfulness") < t["faithfulnessMin"]), "grounding"),
        when((F.col("uncached_ms") >= t["uncachedP95LatencyMs"]) | (F.col("cached_ms") >= t["cachedP95LatencyMs"]), "latency"), when(~F.col("cache_hit"), "cache"),
    )
    rows = results.select("query_id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("failure"))
    return rows.groupBy("query_id", "failure").agg(F.count("*").alias("n"))


SCORES = ("recall_at_5", "ndcg_at_10", "mrr", "citation_accuracy", "citation_evidence_hit", "verified_citation_rate", "hallucination_rate", "abstained")
JUDGED = ("faithfulness", "answer_relevance", "context_precision", "context_recall")


def scores(results: DataFrame) -> DataFrame:
    """(query_id, name, value): one row for each score that was measured; a judge's only where it judged."""
    rows = results.withColumn("abstained", F.col("insufficient").cast("double")).select("query_id", *(F.col(c).cast("double").alias(c) for c in SCORES), *(F.when(F.col("judged"), F.col(c)).cast("double").alias(c) for c in JUDGED))
    return rows.unpivot("query_id", [*SCORES, *JUDGED], "name", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def summary(results: DataFrame) -> DataFrame:
    """Twenty-nine figures overall (language ALL) and for each of the five languages, 0 where there is nothing.

    results: query_id, language, question_type, error, recall_at_5, ndcg_at_10, mrr, citation_accuracy, citation_evidence_hit,
    verified_citation_rate, grounding, hallucination_rate, cache_hit, uncached_ms, cached_ms, insufficient, truncated, judged,
    judge_abstained, faithfulness, answer_relevance, context_precision, context_recall. Rows with an error count only as such;
    quality is that of answerable questions. One pass, and one for each percentiles' column; a result counts for its language and for
    ALL."""
    ok = F.col("error").isNull()
    can, cannot = ok & (F.col("question_type") != "unanswerable"), ok & (F.col("question_type") == "unanswerable")
    mean = lambda c, where: F.coalesce(F.round(F.avg(F.when(where, F.col(c).cast("double"))), 6), F.lit(0.0)).alias(c)
    rate = lambda c, where, name: F.coalesce(F.round(F.avg(F.when(where, c.cast("double"))), 6), F.lit(0.0)).alias(name)
    judged = can & F.coalesce("judged", F.lit(False))
    out = [
        F.count("*").alias("n"), F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("system_errors"), F.count_if(can).alias("answerable"), F.count_if(cannot).alias("unanswerable"),
        rate(~F.col("insufficient"), cannot, "false_answer_rate"), rate(F.col("insufficient"), can, "false_abstention_rate"),
        *(mean(c, can) for c in ("recall_at_5", "ndcg_at_10", "mrr", "citation_accuracy", "grounding", "hallucination_rate", "citation_evidence_hit", "verified_citation_rate")),
        F.count_if(can & F.col("grounding").isNotNull()).alias("grounded_queries"), F.count_if(can & F.col("verified_citation_rate").isNotNull()).alias("verified_queries"), mean("cache_hit", ok),
        rate(~ok, F.lit(True), "system_error_rate"), F.count_if(judged).alias("judged"), *(mean(c, judged) for c in JUDGED),
        rate(F.col("judge_abstained"), judged, "abstention_rate"), rate(F.col("truncated"), F.lit(True), "truncation_rate"),
    ]
    twice = results.withColumn("language", F.explode(F.array(F.col("language"), F.lit("ALL"))))
    slots = results.sparkSession.createDataFrame([(x,) for x in ("ALL", *LANGUAGES)], "language string")
    out = slots.join(twice.groupBy("language").agg(*out), "language", "left")
    for c in ("uncached", "cached"):
        marks = A.percentile_table(twice.where(ok).withColumn("_ms", F.col(f"{c}_ms").cast("double")), "_ms", "language", {f"{c}_p50": 0.5, f"{c}_p95": 0.95}, {})
        out = out.join(marks, "language", "left")
    return out.na.fill(0)


def gates(summarised: DataFrame) -> DataFrame:
    """(metric, value, target, passed): the release gates on the row ALL, where an average over nothing fails, and the floors
    of each language with enough answerable queries."""
    t = THRESHOLDS
    fixed = [
        ("Recall@5", "recall_at_5", ">=", t["recallAt5"], None), ("nDCG@10", "ndcg_at_10", ">=", t["ndcgAt10"], None), ("Citation evidence hit rate", "citation_evidence_hit", ">=", t["citationEvidenceHitRate"], None),
        ("Verified citation rate", "verified_citation_rate", ">=", t["verifiedCitationRate"], "verified_queries"), ("Faithfulness (LLM judge)", "faithfulness", ">=", t["faithfulnessMin"], "judged"),
        ("False answer rate (unanswerable slice)", "false_answer_rate", "<=", t["falseAnswerRateMax"], None), ("False abstention rate (answerable slice)", "false_abstention_rate", "<=", t["falseAbstentionRateMax"], None),
        ("Cache hit rate", "cache_hit", ">=", t["cacheHitRate"], None), ("Uncached p50 latency (ms)", "uncached_p50", "<", t["uncachedP50LatencyMs"], None), ("Uncached p95 latency (ms)", "uncached_p95", "<", t["uncachedP95LatencyMs"], None),
        ("Cached p50 latency (ms)", "cached_p50", "<", t["cachedP50LatencyMs"], None), ("Cached p95 latency (ms)", "cached_p95", "<", t["cachedP95LatencyMs"], None),
    ]
    test = lambda c, op, v: {">=": F.col(c) >= v, "<=": F.col(c) <= v, "<": F.col(c) < v}[op]

    def row(name: Column, c: str, op: str, v: float, needs: str | None) -> Column:
        passed = test(c, op, v) & (F.col(needs) > 0) if needs else test(c, op, v)
        return F.struct(name.alias("metric"), F.col(c).alias("value"), F.lit(f"{op} {v:g}").alias("target"), passed.alias("passed"))

    overall = F.array(*(F.when(F.col("unanswerable") > 0, row(F.lit(n), c, *r)) if c == "false_answer_rate" else row(F.lit(n), c, *r) for n, c, *r in fixed))
    named = lambda n: F.concat(F.lit(f"{n} ["), F.col("language"), F.lit("]"))
    each = F.array(row(named("Recall@5"), "recall_at_5", ">=", t["perLanguageRecallAt5"], None), row(named("nDCG@10"), "ndcg_at_10", ">=", t["perLanguageNdcgAt10"], None))
    one = F.when(F.col("language") == "ALL", overall).when(F.col("answerable") >= t["perLanguageMinQueries"], each)
    return summarised.select(F.inline(F.filter(one, lambda r: r.isNotNull())))


def dataset_violations(records: DataFrame, least: int = 25, least_language: int = 5) -> DataFrame:
    """(violation, id): what is wrong with golden records (id, language, question, question_type, chunk_ids, document, pages,
    points); a repeated id once, and counts that are too small under the id of the language or no id."""
    answerable = F.col("question_type") != "unanswerable"
    when = lambda c, name: F.when(F.coalesce(c, F.lit(True)), F.lit(name))
    bad = F.array(
        when(F.col("id") == "", "empty_id"), when(F.coalesce("question", F.lit("")) == "", "empty_question"), when(~F.col("language").isin(*LANGUAGES), "unknown_language"),
        when(~answerable & (F.size("chunk_ids") > 0), "unanswerable_with_chunks"), when(answerable & (F.size("chunk_ids") <= 0), "answerable_without_chunks"),
        when(answerable & (F.coalesce("document", F.lit("")) == ""), "answerable_without_document"), when(answerable & (F.size("pages") <= 0), "answerable_without_pages"), when(answerable & (F.size("points") <= 0), "answerable_without_points"),
    )
    rows = records.select(F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("violation"), "id")
    twice = records.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("violation"), "id")
    few = records.where(answerable).groupBy("language").count().where(F.col("count") < least_language).select(F.lit("too_few_of_language").alias("violation"), F.col("language").alias("id"))
    small = records.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit("too_few_records").alias("violation"), F.lit(None).cast("string").alias("id"))
    return rows.unionByName(twice).unionByName(few).unionByName(small)


def subset(records: DataFrame, languages: list[str] | None, size: int | None) -> DataFrame:
    """Records (ord) of the languages, if any are named, and the first `size` of them, if given."""
    rows = records.where(F.col("language").isin(*languages)) if languages else records
    return rows.orderBy("ord").limit(size) if size else rows


def absent_terms(probes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The candidates (id, terms) none of whose terms occurs in any chunk (content), without regard to case. Only whether a
    term occurs is looked for: each task sees the terms, if they are within the bound of what is sent, and passes on each that it found."""
    terms = probes.select("id", F.explode(F.array_distinct(F.transform("terms", F.lower))).alias("term"))
    words = terms.select("term").distinct()
    hits = chunks.select(F.lower("content").alias("c")).join(few(words, F.length("term") + 40), F.contains(F.col("c"), F.col("term"))).select("term").distinct()
    return probes.join(terms.join(hits, "term").select("id").distinct(), "id", "left_anti")


def substantive(chunks: DataFrame, least: int = 200) -> DataFrame:
    return chunks.where(F.length(F.trim("content")) >= least)


def multi_hop_pairs(chunks: DataFrame, attempts: int = 12) -> DataFrame:
    """(language, attempt, first, second): pairs of chunks (document_id, language, ord, chunk_id) of neighbouring documents, in
    turn, at growing offsets; a language with one document only has none."""
    # Only the first documents of a language are met: as many as there are attempts, and one more. Each task keeps so many of a
    # language before they are ranked, and only their chunks are numbered.
    ids = chunks.select("language", "document_id").distinct()
    size = ids.groupBy("language").agg(F.count("*").alias("_docs")).where("_docs >= 2")
    first = ids.withColumn("_d", F.row_number().over(Window.partitionBy("language").orderBy("document_id")) - 1).where(F.col("_d") <= attempts)
    first = first.join(size, "language")
    doc = Window.partitionBy("language", "document_id")
    rows = chunks.join(first.select("language", "document_id"), ["language", "document_id"], "left_semi")
    rows = rows.withColumns({"_i": F.row_number().over(doc.orderBy("ord", "chunk_id")) - 1, "_n": F.count("*").over(doc)})
    docs = first.join(rows.groupBy("language", "document_id").agg(F.max("_n").alias("_n")), ["language", "document_id"])
    tries = size.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))

    def side(shift: int, part: float, name: str) -> DataFrame:
        at = tries.withColumn("_d", (F.col("attempt") + shift) % F.col("_docs")).join(docs.drop("_docs"), ["language", "_d"])
        spot = F.floor(((F.col("attempt") + part) / attempts * F.col("_n")) % F.col("_n"))
        return at.withColumn("_i", spot).join(rows.select("language", "document_id", "_i", F.col("chunk_id").alias(name)), ["language", "document_id", "_i"]).select("language", "attempt", name)

    return side(0, 0.0, "first").join(side(1, 0.5, "second"), ["language", "attempt"])


def rolling_hash(text: Column) -> Column:
    """The 32-bit hash h = 31 h + unit over a text's UTF-16 units."""
    units = let(F.hex(F.encode(text, "UTF-16BE")), lambda h: F.transform(F.sequence(F.lit(0), F.length(h).cast("int") - 4, F.lit(4)), lambda i: F.conv(F.substring(h, i + 1, F.lit(4)), 16, 10).cast("long")))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32)))


def picked(text: Column, least: int, most: int) -> Column:
    """A number from least to most that depends on the text alone."""
    return least + rolling_hash(text) % (most - least + 1)


# Opening and closing quotes, and words that are no names by themselves.
QUOTES = (r'"([^"]+)"', r"'([^']+)'", "„([^“”\"]+)[“”\"]", "“([^”]+)”", "«([^»]+)»")
STOP_EN = "a an the and or but if of in on at to for by with about from as is are was were be been does do did has have had what which who whom whose when where why how it its this that these those there their they not no"
STOP_DE = "der die das den dem des ein eine einen einem einer eines und oder aber wenn von vom im in an am auf zu zur zum für mit über aus als ist sind war waren wird werden wurde wurden hat haben hatte was welche welcher welches wer wann wo warum wie es sie er dies diese dieser dieses nicht kein keine"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"


def entity_terms(query: Column, language: Column) -> Column:
    """What a query is about: its quoted phrases, then its runs of capitalised words. Not a run at the begin of a sentence, nor,
    in German, a single word; stopwords break runs. Distinct without regard to case, by first sight."""
    stop = F.when(language == "DE", F.array(*map(F.lit, STOP_DE.split()))).otherwise(F.array(*map(F.lit, STOP_EN.split())))
    words = lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))
    none = F.array().cast("array<string>")

    def term(run: Column, begin: Column) -> Column:
        kept = (begin > 0) & ((F.size(run) >= 2) | ((F.size(run) == 1) & (language != "DE")))
        return F.when(kept, F.array(F.array_join(run, " "))).otherwise(none)

    def runs(s: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), none.alias("run"), F.lit(-1).alias("begin"), none.alias("out"))

        def step(a: Column, w: Column) -> Column:
            name = w.rlike(r"^\p{Lu}") & ~F.array_contains(stop, F.lower(w))
            go = F.struct((a.i + 1).alias("i"), F.concat(a.run, F.array(w)).alias("run"), F.when(F.size(a.run) == 0, a.i).otherwise(a.begin).alias("begin"), a.out.alias("out"))
            end = F.struct((a.i + 1).alias("i"), none.alias("run"), F.lit(-1).alias("begin"), F.concat(a.out, term(a.run, a.begin)).alias("out"))
            return F.when(name, go).otherwise(end)

        return F.aggregate(words(s), start, step, lambda a: F.concat(a.out, term(a.run, a.begin)))

    quoted = F.flatten(F.array(*(F.regexp_extract_all(query, F.lit(p), F.lit(1)) for p in QUOTES)))
    found = F.concat(quoted, F.flatten(F.transform(F.split(query, r"(?U)(?<=[.!?])\s+"), runs)))
    good = F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: F.exists(words(t), lambda w: ~F.array_contains(stop, F.lower(w))))
    return let(good, lambda g: F.filter(g, lambda t, i: F.array_position(F.transform(g, F.lower), F.lower(t)) == i + 1))


def missing_terms(terms: Column, evidence: Column) -> Column:
    """The terms that the evidence doesn't show: neither as a part of it, nor by words that share five letters at the begin with
    each of the term's words that are as long."""
    low = F.lower(evidence)

    def missing(e: Column) -> Column:
        def shown(t: Column) -> Column:
            long = F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 5)
            alike = F.forall(long, lambda w: F.exists(e.starts, lambda x: x == F.left(w, F.lit(5))))
            return F.contains(e.text, F.lower(t)) | ((F.size(long) > 0) & alike)

        return F.filter(terms, lambda t: ~shown(t))

    starts = F.array_distinct(F.transform(F.filter(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 5), lambda w: F.left(w, F.lit(5))))
    return let(F.struct(low.alias("text"), starts.alias("starts")), missing)


def report(rows: list[dict], title: str) -> str:
    """A Markdown table of a collected summary, at most a few rows."""
    if not rows:
        return f"# {title}\n\n(none)\n"
    head = list(rows[0])
    cell = lambda v: f"{v:g}" if isinstance(v, float) else re.sub(r"[|\n]", " ", str(v))
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows)]
    return "\n".join(lines) + "\n"

