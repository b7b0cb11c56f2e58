"""Whether what was found suffices for an answer, and how it enters a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import safety as G

ABSTAINS = "INSUFFICIENT_EVIDENCE"


def resolved(relevance: Column, rerank: Column, retrieval: Column) -> Column:
    """A chunk's absolute relevance: its own, else its rerank score, else its retrieval score."""
    return F.coalesce(relevance, rerank, retrieval)


def by_scale(scale: Column, encoder: float, heuristic: float) -> Column:
    """Scores of a cross-encoder have a threshold of their own; all others have the heuristic one."""
    return F.when(F.coalesce(scale == "cross_encoder", F.lit(False)), encoder).otherwise(heuristic)


def scale_of(scale: Column) -> Column:
    """An aggregate: which scales a query's chunks carry (unknown, mixed, cross_encoder or heuristic)."""
    found = F.collect_set(scale)  # two values at most
    return F.when(F.size(found) == 0, "unknown").when(F.size(found) > 1, "mixed").otherwise(F.get(found, 0))


def assess(chunks: DataFrame, least: int = 2, encoder: float = 0.25, heuristic: float = 0.14, top3: float = 0.3, top3_heuristic: float = 0.14, scoped: Column | None = None) -> DataFrame:
    """(query_id, n, top1, top3_mean, scale, verdict) from chunks (query_id, ord, relevance, scale).

    insufficient: fewer chunks than required (one if the question is scoped to a document), none at its scale's threshold, or
    the mean of the first required ones below half the mean of their thresholds; sufficient: the mean of the first three
    reaches the mean of their scales' bars; ambiguous between. A query without chunks has no row here."""
    need = F.lit(max(1, least)) if scoped is None else F.when(scoped, 1).otherwise(max(1, least))
    limit = by_scale(F.col("scale"), encoder, heuristic)
    rows = chunks.withColumns({"_need": need, "_limit": limit, "_bar": by_scale(F.col("scale"), top3, top3_heuristic)})
    first = lambda c, n: F.avg(F.when(F.col("ord") <= n, F.col(c)))
    g = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("_need").alias("_need"), F.max(F.when(F.col("ord") == 1, F.col("relevance"))).alias("top1"), first("relevance", 3).alias("_m"), first("_bar", 3).alias("_bar"),
        F.bool_or(F.col("relevance") >= F.col("_limit")).alias("_strong"), first("relevance", F.col("_need")).alias("_mean"), first("_limit", F.col("_need")).alias("_limit"), scale_of(F.col("scale")).alias("scale"),
    )
    enough = (F.col("n") >= F.col("_need")) & F.col("_strong") & (F.col("_mean") >= 0.5 * F.col("_limit"))
    verdict = F.when(~F.coalesce(enough, F.lit(False)), "insufficient").when(F.round("_m", 9) >= F.round("_bar", 9), "sufficient").otherwise("ambiguous")
    return g.select("query_id", "n", "top1", F.round("_m", 6).alias("top3_mean"), "scale", verdict.alias("verdict"))


def meeting(chunks: DataFrame, encoder: float = 0.25, heuristic: float = 0.14) -> DataFrame:
    """The chunks that reach their own scale's threshold."""
    return chunks.where(F.col("relevance") >= by_scale(F.col("scale"), encoder, heuristic))


def web_gate(assessed: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """Adds n_web and proceeds: local evidence suffices, or there are `least` web sources (query_id)."""
    n = sources.groupBy("query_id").agg(F.count("*").alias("n_web"))
    out = assessed.join(n, "query_id", "left").withColumn("n_web", F.coalesce("n_web", F.lit(0)))
    return out.withColumn("proceeds", (F.col("verdict") != "insufficient") | (F.col("n_web") >= least))


def corrects(verdict: Column, enabled: bool = True) -> Column:
    """Whether the corrective loop runs: in the ambiguous band only."""
    return F.lit(enabled) & (verdict == "ambiguous")


def reflects(checked: Column, unsupported: Column, least: int = 2, share: float = 0.5) -> Column:
    """Whether an answer is written anew: enough of its cited sentences were checked, and too many of them not supported."""
    return (checked >= least) & (unsupported / F.when(checked > 0, checked) >= share)


def abstains(answer: Column) -> Column:
    """Whether the whole answer is the abstention token, but for a code fence, marks and white space around it."""
    x = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)^```[a-z]*\s*", ""), r"\s*```$", "")
    return F.regexp_replace(F.regexp_replace(x, r"[.!?*_\s]+$", ""), r"^\s+", "") == ABSTAINS


def begins_abstaining(answer: Column) -> Column:
    """Whether an answer begins with the token, which no letter, digit or underscore continues."""
    x = F.regexp_replace(F.regexp_replace(answer, r"(?U)^\s+", ""), r"(?i)^```[a-z]*\s*", "")
    return x.rlike(rf"^{ABSTAINS}(?![\p{{L}}\p{{N}}_])")


def evidence_block(index: Column, page: Column, title: Column, content: Column, context: Column) -> Column:
    """A chunk as it stands in a prompt, its parts sanitized and marked as untrusted."""
    number = index.cast("string")
    part = lambda mark, label, text: F.concat(F.lit(f"{mark}:\n```text\n"), G.sanitize_payload(text, F.concat(F.lit(label), number)), F.lit("\n```\n"))
    head = F.concat(F.lit('<evidence_chunk index="'), number, F.lit('" page="'), page.cast("string"), F.lit('" section="'), G.sanitize_payload(title, F.concat(F.lit("section title "), number)), F.lit('">\n'))
    more = F.when(F.coalesce(context, F.lit("")) != "", part("UNTRUSTED_RETRIEVAL_CONTEXT", "retrieval context ", context)).otherwise("")
    return F.concat(head, part("UNTRUSTED_DOCUMENT_TEXT", "document chunk ", content), more, F.lit("</evidence_chunk>"))


def prompt_evidence(chunks: DataFrame, between: str = "\n\n---\n\n") -> DataFrame:
    """(query_id, evidence): the blocks of each query's chunks (query_id, ord, page, title, content, context) in order."""
    rows = chunks.select("query_id", "ord", evidence_block(F.col("ord"), F.col("page"), F.col("title"), F.col("content"), F.col("context")).alias("b"))
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("_l"))  # as many as a prompt holds
    return g.select("query_id", F.array_join(F.col("_l.b"), between).alias("evidence"))


# What a prompt says when the evidence is weak.
CAUTION = f"Retrieval confidence for this query is low. If the specific entity, program, or document named in the question does not appear in the evidence above, output exactly `{ABSTAINS}` and nothing else. Do not answer about a similar but differently-named entity. Do not use this to avoid a partial answer that the evidence does support."
LACKING = "\nThe following terms from the question were not found in the evidence: "


def caution_block(missing: Column) -> Column:
    """What follows the evidence in a prompt of weak evidence, with the terms that it lacks, sanitized."""
    terms = F.transform(F.coalesce(missing, F.array().cast("array<string>")), lambda t, i: G.sanitize_payload(t, F.concat(F.lit("query term "), (i + 1).cast("string"))))
    named = F.when(F.size(terms) > 0, F.concat(F.lit(LACKING), F.array_join(terms, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("\n\n" + CAUTION), named, F.lit("\n\n"))


def web_block(index: Column, title: Column, url: Column, snippet: Column) -> Column:
    """A web source as it stands in a prompt, its texts sanitized and marked as untrusted."""
    number = index.cast("string")
    clean = lambda text, label: G.sanitize_payload(F.coalesce(text, F.lit("")), F.concat(F.lit(label), number))
    parts = [F.concat(F.lit("web_source_"), number, F.lit(":")), F.lit("  untrusted_web_title:"), F.concat(F.lit("  "), clean(title, "web source title ")), F.concat(F.lit("  url: "), url), F.lit("  untrusted_web_snippet:"), F.concat(F.lit("  "), clean(snippet, "web source snippet "))]
    return F.concat_ws("\n", *parts)


def protect_web(sources: DataFrame) -> DataFrame:
    """Web sources (query_id, ord, title, url, snippet) with title and snippet sanitized, and whether they are suspicious or blocked."""
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("snippet", F.lit("")))
    scanned = sources.withColumn("_scan", G.injection_scan(G.strip_invisible(whole)))
    name = lambda kind: F.concat(F.lit(f"web source {kind} "), F.col("ord").cast("string"))
    clean = lambda c: G.sanitize_payload(F.coalesce(c, F.lit("")), name(c))
    return scanned.withColumns({"title": clean("title"), "snippet": clean("snippet"), "suspicious": F.col("_scan.suspicious"), "blocked": F.col("_scan.blocked")}).drop("_scan")


def web_evidence(sources: DataFrame) -> DataFrame:
    """(query_id, web, n_web, suspicious_web, blocked_web): the blocks of each query's protected sources in order."""
    rows = sources.select("query_id", "ord", web_block(F.col("ord"), F.col("title"), F.col("url"), F.col("snippet")).alias("b"), "suspicious", "blocked")
    g = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "b"))).alias("_l"), F.count("*").alias("n_web"), F.count_if("suspicious").alias("suspicious_web"), F.count_if("blocked").alias("blocked_web"))
    return g.select("query_id", F.array_join(F.col("_l.b"), "\n\n").alias("web"), "n_web", "suspicious_web", "blocked_web")


def protect(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, title, content, context) with content and context sanitized, and whether the whole is suspicious or
    blocked; counts of these are sums over the columns."""
    whole = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("context", F.lit("")))
    name = lambda kind: F.concat(F.lit(f"document {kind} "), F.col("chunk_id").cast("string"))
    scanned = chunks.withColumn("_scan", G.injection_scan(G.strip_invisible(whole)))
    return scanned.withColumns({"content": G.sanitize_payload(F.col("content"), name("chunk")), "context": G.sanitize_payload(F.col("context"), name("context")), "suspicious": F.col("_scan.suspicious"), "blocked": F.col("_scan.blocked")}).drop("_scan")
