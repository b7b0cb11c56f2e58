"""Queries on evidence, prompts, answers and what answers may show."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftline.functions import safety as G
from siftline.functions import text as X
from siftline.operators import answers as W
from siftline.operators import evidence as E
from siftline.plans.registry import POOL, pool, query
from siftline.sources.tables import table

CHUNKS = f"""{POOL}, chunks AS (SELECT query_id, chunk_id, document_id, ord, page, title, content, context, scale, coalesce(similarity, CASE WHEN chunk_id % 5 > 0 THEN lexical END, score) AS relevance FROM listed)"""
LIMITS = "CASE WHEN scale = 'cross_encoder' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END"
ASSESSED = f"""{CHUNKS}, e AS (SELECT *, {LIMITS} AS lim, CASE WHEN scale = 'cross_encoder' THEN 0.62::DOUBLE ELSE 0.58::DOUBLE END AS bar, CASE WHEN query_id % 3 = 0 THEN 1 ELSE 2 END AS need FROM chunks),
g AS (SELECT query_id, count(*) AS n, max(need) AS need, max(relevance) FILTER (ord = 1) AS top1, avg(relevance) FILTER (ord <= 3) AS m, avg(bar) FILTER (ord <= 3) AS b, bool_or(relevance >= lim) AS strong, avg(relevance) FILTER (ord <= need) AS a, avg(lim) FILTER (ord <= need) AS l,
  CASE count(DISTINCT scale) WHEN 0 THEN 'unknown' WHEN 1 THEN any_value(scale) ELSE 'mixed' END AS scale FROM e GROUP BY 1),
assessed AS (SELECT query_id, n, top1, round(m, 6) AS top3_mean, scale, CASE WHEN NOT (n >= need AND strong AND a >= 0.5 * l) THEN 'insufficient' WHEN round(m, 9) >= round(b, 9) THEN 'sufficient' ELSE 'ambiguous' END AS verdict FROM g)"""


def chunks(spark, d):
    """The pools' rows as retrieved chunks, with an absolute relevance from whichever score there is."""
    p = pool(spark, d)
    rerank = F.when(F.col("chunk_id") % 5 > 0, F.col("lexical"))
    return p.withColumn("relevance", E.resolved(F.col("similarity"), rerank, F.col("score")))


def assessed(spark, d):
    return E.assess(chunks(spark, d), 2, 0.6, 0.5, 0.62, 0.58, scoped=F.col("query_id") % 3 == 0)


@query(f"WITH {ASSESSED} SELECT query_id, n, verdict <> 'insufficient' AS sufficient FROM assessed")
def evidence_gate(spark, d):
    return assessed(spark, d).select("query_id", "n", (F.col("verdict") != "insufficient").alias("sufficient"))


@query(f"WITH {ASSESSED} SELECT * FROM assessed")
def evidence_assess(spark, d):
    return assessed(spark, d)


@query(f"WITH {CHUNKS} SELECT query_id, chunk_id, ord::INTEGER AS ord FROM chunks WHERE relevance >= {LIMITS}")
def evidence_meeting(spark, d):
    return E.meeting(chunks(spark, d), 0.6, 0.5).select("query_id", "chunk_id", "ord")


@query(f"""WITH {ASSESSED}, w AS (SELECT page_id % 20 AS query_id, count(*) AS n_web FROM pages WHERE url LIKE 'http%' GROUP BY 1)
SELECT query_id, verdict, coalesce(n_web, 0) AS n_web, verdict <> 'insufficient' OR coalesce(n_web, 0) >= 14 AS proceeds, verdict = 'ambiguous' AS corrects FROM assessed LEFT JOIN w USING (query_id)""")
def web_gate(spark, d):
    web = table(spark, d, "pages").where("url like 'http%'").select((F.col("page_id") % 20).alias("query_id"))
    return E.web_gate(assessed(spark, d), web, 14).select("query_id", "verdict", "n_web", "proceeds", E.corrects(F.col("verdict")).alias("corrects"))


ABSTAINING = "CASE turn % 5 WHEN 0 THEN '```text' || chr(10) || 'INSUFFICIENT_EVIDENCE. ' || chr(10) || '```' WHEN 1 THEN ' INSUFFICIENT_EVIDENCE - ' || text WHEN 2 THEN 'INSUFFICIENT_EVIDENCES' WHEN 3 THEN text ELSE '**INSUFFICIENT_EVIDENCE**' END"


@query(rf"""WITH a AS (SELECT conv_id, turn, regexp_replace(trim({ABSTAINING}), '(?i)^```[a-z]*\s*', '') AS x FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '\s*```$', ''), '[.!?*_\s]+$', '')) = 'INSUFFICIENT_EVIDENCE' AS abstains, regexp_matches(x, '^INSUFFICIENT_EVIDENCE($|[^\p{{L}}\p{{N}}_])') AS begins FROM a""")
def abstention(spark, d):
    rows = table(spark, d, "conversations").withColumn("a", F.expr(ABSTAINING.replace("chr(10)", "char(10)")))
    return rows.select("conv_id", "turn", E.abstains(F.col("a")).alias("abstains"), E.begins_abstaining(F.col("a")).alias("begins"))


@query("SELECT doc_id, doc_id % 7 >= 2 AND (doc_id % 5) / CASE WHEN doc_id % 7 > 0 THEN (doc_id % 7)::DOUBLE END >= 0.5 AS reflects FROM documents")
def reflection(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", E.reflects(i % 7, i % 5).alias("reflects"))


_INVISIBLE = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", G.INVISIBLE)
_matches = lambda x, p: f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')"
_any = lambda x: " OR ".join(_matches(x, p) for _, p, _ in G.INJECTION)
_score = lambda x: "(" + " + ".join(f"CASE WHEN {_matches(x, p)} THEN {n} ELSE 0 END" for _, p, n in G.INJECTION) + ")"
_blocked = lambda x: f"({_score(x)} >= 10 OR " + " OR ".join(_matches(x, p) for k, p, _ in G.INJECTION if k in G.BLOCKING) + ")"


def _payloads(name: str, source: str, column: str, label: str) -> str:
    """CTE: what of a column may enter a prompt, as <column>_safe; label is SQL."""
    x, removed = "x", f"'[Potential prompt injection content removed from ' || {label} || ']'"
    lines = f"trim(array_to_string(list_filter(regexp_split_to_array(x, '\\r?\\n'), lambda l: NOT ({_any('l')})), chr(10)))"
    return f"""{name}_x AS (SELECT *, trim(regexp_replace(coalesce({column}, ''), '{_INVISIBLE}', ' ', 'g')) AS x FROM {source}), {name}_l AS (SELECT *, {lines} AS kept FROM {name}_x),
{name} AS (SELECT * EXCLUDE (x, kept), CASE WHEN x = '' THEN '[No ' || {label} || ' available]' WHEN NOT ({_any(x)}) THEN x WHEN kept = '' THEN {removed} WHEN {_blocked(x)} THEN {removed} || chr(10) || kept ELSE kept END AS {column}_safe FROM {name}_l)"""


_FENCED = "'%s:' || chr(10) || '```text' || chr(10) || %s || chr(10) || '```' || chr(10)"


@query(f"""WITH {POOL}, best AS (SELECT * FROM listed WHERE ord <= 8), {_payloads('a', 'best', 'title', "'section title ' || ord")}, {_payloads('b', 'a', 'content', "'document chunk ' || ord")}, {_payloads('c', 'b', 'context', "'retrieval context ' || ord")},
e AS (SELECT query_id, ord, '<evidence_chunk index="' || ord || '" page="' || page || '" section="' || title_safe || '">' || chr(10) || {_FENCED % ('UNTRUSTED_DOCUMENT_TEXT', 'content_safe')} || CASE WHEN coalesce(context, '') <> '' THEN {_FENCED % ('UNTRUSTED_RETRIEVAL_CONTEXT', 'context_safe')} ELSE '' END || '</evidence_chunk>' AS b FROM c)
SELECT query_id, string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ord) AS evidence FROM e GROUP BY 1""")
def prompt_evidence(spark, d):
    return E.prompt_evidence(chunks(spark, d).where(F.col("ord") <= 8))


@query(f"""WITH {POOL}, w AS (SELECT chunk_id, content, context, regexp_replace(coalesce(title, '') || chr(10) || coalesce(content, '') || chr(10) || coalesce(context, ''), '{_INVISIBLE}', ' ', 'g') AS whole FROM pool), {_payloads('a', 'w', 'content', "'document chunk ' || chunk_id")}, {_payloads('b', 'a', 'context', "'document context ' || chunk_id")}
SELECT chunk_id, content_safe AS content, context_safe AS context, ({_any('whole')}) AS suspicious, {_blocked('whole')} AS blocked FROM b""")
def protected_chunks(spark, d):
    return E.protect(pool(spark, d).select("chunk_id", "title", "content", "context")).drop("title")


# Answers made of the documents' texts, with markers of all sorts put into them.
ANSWERS = """answers AS (SELECT doc_id, replace(text, '. ', CASE doc_id % 4 WHEN 0 THEN ' [' || (doc_id % 9) || ']. ' WHEN 1 THEN ' [1, ' || (doc_id % 13) || ']. ' WHEN 2 THEN ' [WEB-1]. ' ELSE '. ' END) AS answer FROM documents WHERE text IS NOT NULL)"""
_LISTS = r"flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: regexp_split_to_array(g, '\s*,\s*')))"


def cited_answers(spark, d):
    i = F.col("doc_id")
    mark = F.when(i % 4 == 0, F.concat(F.lit(" ["), (i % 9).cast("string"), F.lit("]. "))).when(i % 4 == 1, F.concat(F.lit(" [1, "), (i % 13).cast("string"), F.lit("]. "))).when(i % 4 == 2, F.lit(" [WEB-1]. ")).otherwise(F.lit(". "))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit(". "), mark).alias("answer"))


@query(rf"""WITH {ANSWERS}, n AS (SELECT doc_id, answer, list_transform({_LISTS}, lambda x: try_cast(x AS INTEGER)) AS c FROM answers),
k AS (SELECT *, list_filter(c, lambda x: x BETWEEN 1 AND 8) AS good FROM n), f AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(good), lambda v: {{'p': list_position(good, v), 'v': v}})), lambda s: s.v) AS cited FROM k)
SELECT doc_id, regexp_replace(regexp_replace(answer, '[ \t]*\[(?:0|9|[1-9][0-9]+)\]', '', 'g'), '\[1, (?:0|9|[1-9][0-9]+)\]', '[1]', 'g') AS answer, CASE WHEN len(good) = 0 THEN '1,2,3,4,5,6,7,8' ELSE array_to_string(cited, ',') END AS cited, (len(c) - len(good))::INTEGER AS invalid, len(good) = 0 AS fell_back FROM f""")
def citations(spark, d):
    rows = cited_answers(spark, d).select("doc_id", W.resolve_citations(F.col("answer"), F.lit(8)).alias("r"))
    return rows.select("doc_id", "r.answer", F.array_join(F.col("r.cited").cast("array<string>"), ",").alias("cited"), "r.invalid", "r.fell_back")


@query(rf"""WITH {ANSWERS}, s AS (SELECT doc_id, unnest(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))) AS sentence FROM answers),
c AS (SELECT doc_id, trim(sentence, ' ' || chr(9) || chr(10) || chr(13)) AS sentence, list_filter(list_transform({_LISTS.replace('answer', 'sentence')}, lambda x: try_cast(x AS INTEGER)), lambda x: x BETWEEN 1 AND 8) AS good FROM s)
SELECT doc_id, sentence, array_to_string(list_transform(list_sort(list_transform(list_distinct(good), lambda v: {{'p': list_position(good, v), 'v': v}})), lambda s: s.v), ',') AS cited FROM c WHERE len(good) > 0""")
def cited_sentences(spark, d):
    rows = cited_answers(spark, d).select("doc_id", F.explode(W.cited_sentences(F.col("answer"), F.lit(8))).alias("s"))
    return rows.select("doc_id", "s.sentence", F.array_join(F.col("s.cited").cast("array<string>"), ",").alias("cited"))


@query("SELECT l_orderkey AS answer_id, l_suppkey AS document_id, (l_quantity::INTEGER % 3) AS page, l_partkey % 2 AS chunk_id, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3, 4")
def distinct_citations(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.col("l_suppkey").alias("document_id"), (F.col("l_quantity").cast("int") % 3).alias("page"), (F.col("l_partkey") % 2).alias("chunk_id"), F.col("l_linenumber").alias("ord"))
    return W.distinct_citations(rows)


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND try_cast(CASE doc_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'x' WHEN 2 THEN '0' ELSE '12' END AS INTEGER) > 0 THEN 1 ELSE 0 END AS n_valid FROM documents")
def citation_rows(spark, d):
    i = F.col("doc_id")
    page = F.when(i % 4 == 0, "7").when(i % 4 == 1, "x").when(i % 4 == 2, "0").otherwise("12")
    row = F.struct(F.when(i % 3 > 0, i.cast("string")).alias("document_id"), page.alias("page"), i.cast("string").alias("chunk_id"))
    return table(spark, d, "documents").select("doc_id", F.size(W.valid_citations(F.array(row))).alias("n_valid"))


_quoted = lambda p: p.replace("'", "''")
_replace = lambda t, p, by="[REDACTED]": f"regexp_replace({t}, '{_quoted(p)}', '{by}', 'g')"
_count = lambda t, p: f"len(regexp_extract_all({t}, '{_quoted(p)}'))"


def _stages(patterns, begin: str, by: str = "[REDACTED]") -> tuple[str, str, str]:
    """CTEs that apply patterns one after the other to column x, counting in n; the last one's name and all of them."""
    out, name = [], begin
    for i, p in enumerate(patterns):
        out.append(f"{begin}_{i} AS (SELECT * REPLACE ({_replace('x', p, by)} AS x, n + {_count('x', p)} AS n) FROM {name})")
        name = f"{begin}_{i}"
    return ", ".join(out), name, by


# The patterns with lookaround, written out for an engine without it.
_SSN = r"\b((?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])-(?:0[1-9]|[1-9]\d)-(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3}))\b"
_PREFIXED = r"(^|[^0-9])(?:\+\d{1,3}[-.\s]?(?:\(\d{2,4}\)[-.\s]?)?\d{2,4}[-.\s]?\d{3,4}(?:[-.\s]?\d{2,4})?)($|[^0-9])"
_CUED = r"(?i)(\b(?:tel|telefon|telephone|phone|mobil|mobile|handy|fax)\b\.?[^\p{L}\p{N}]{0,4})(?:\(\d{2,4}\)[-.\s]?)?\d{2,4}[-.\s]\d{3,4}(?:[-.\s]\d{2,4})?($|[^0-9])"
_secrets, _after_secrets, _ = _stages(G.SECRETS, "s")


@query(f"WITH s AS (SELECT doc_id, text AS x, 0 AS n FROM documents), {_secrets} SELECT doc_id, x AS text, n::INTEGER AS n_secrets FROM {_after_secrets}")
def secret_redact(spark, d):
    text, n = G.redact_secrets(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text"), n.alias("n_secrets"))


def _private(x: str) -> str:
    x = _replace(_replace(x, _SSN), G.EMAIL)
    x = _replace(_replace(x, _PREFIXED, r"\1[REDACTED]\2"), _PREFIXED, r"\1[REDACTED]\2")
    return _replace(x, _CUED, r"\1[REDACTED]\2")


# Texts that call for every part of the filter.
RISKY = """CASE doc_id % 7 WHEN 0 THEN text || ' Here is the system prompt' WHEN 1 THEN text || ' <script>x()</script> <!-- a --> end' WHEN 2 THEN 'see [a]( javascript:alert) and [b](http://x.y) ' || text WHEN 3 THEN 'Tel: 030 1234 5678, SSN 123-45-6789, 000-12-3456 ' || text WHEN 4 THEN repeat('same line' || chr(10), 8) WHEN 5 THEN '  ' ELSE text END"""


def risky(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.expr(RISKY.replace("chr(10)", "char(10)")).alias("text"))


@query(f"SELECT doc_id, {_private('text')} AS text FROM (SELECT doc_id, {RISKY} AS text FROM documents WHERE text IS NOT NULL)")
def pii_redact(spark, d):
    return risky(spark, d).select("doc_id", G.redact_pii(F.col("text")).text.alias("text"))


_ANY = r"(^|[^0-9])(?:\+\d{1,3}[-.\s]?)?(?:\(\d{2,4}\)[-.\s]?)?\d{2,4}[-.\s]\d{3,4}[-.\s]\d{2,4}(?:[-.\s]\d{2,4})?($|[^0-9])"


@query(f"SELECT doc_id, {_replace(_replace(_replace(_replace('text', _SSN), G.EMAIL), _ANY, chr(92) + '1[REDACTED]' + chr(92) + '2'), _ANY, chr(92) + '1[REDACTED]' + chr(92) + '2')} AS text FROM (SELECT doc_id, {RISKY} AS text FROM documents WHERE text IS NOT NULL)")
def pii_strict(spark, d):
    return risky(spark, d).select("doc_id", G.redact_pii(F.col("text"), "strict").text.alias("text"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{G.EMAIL}'), lambda x: lower(x)))), ',') AS emails FROM documents WHERE text IS NOT NULL")
def evidence_emails(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(G.emails(F.col("text")), ",").alias("emails"))


_html, _after_html, _ = _stages(G.HTML, "h", "")


@query(f"WITH h AS (SELECT page_id, html AS x, 0 AS n FROM pages WHERE html IS NOT NULL), {_html} SELECT page_id, x AS html, n::INTEGER AS n_removed FROM {_after_html}")
def html_strip(spark, d):
    rows = table(spark, d, "pages").where("html is not null").select("page_id", G.strip_html(F.col("html")).alias("r"))
    return rows.select("page_id", F.col("r.text").alias("html"), F.col("r.n").alias("n_removed"))


@query(f"SELECT doc_id, {' OR '.join(f'''regexp_matches(text, '{_quoted(p)}')''' for p in G.LEAKS)} AS leaks, {' OR '.join(f'''regexp_matches(text, '{_quoted(p)}')''' for p in G.PROMPT_LEAKS)} AS prompt_leaks FROM (SELECT doc_id, {RISKY} AS text FROM documents WHERE text IS NOT NULL)")
def leak_checks(spark, d):
    return risky(spark, d).select("doc_id", G.leaks(F.col("text")).alias("leaks"), G.prompt_leaks(F.col("text")).alias("prompt_leaks"))


_blank = "' ' || chr(9) || chr(10) || chr(13)"
_LINKS = r"(?i)(!?\[[^\]]*\])\(\s*(?:javascript|data|vbscript|file):[^)]*\)"
_refusal = "CASE upper(lang) " + " ".join(f"WHEN '{k}' THEN '{_quoted(v)}'" for k, v in G.REFUSED_ANSWER.items()) + f" ELSE '{_quoted(G.REFUSED_ANSWER['EN'])}' END"
_s2, _a2, _ = _stages(G.SECRETS, "b")
_h2, _ah2, _ = _stages(G.HTML, "e", "")


@query(rf"""WITH r AS (SELECT doc_id, lang, trim({RISKY}, {_blank}) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, lang, length(t) > 24000 AS cut, CASE WHEN length(t) > 24000 THEN rtrim(left(t, 23900), {_blank}) || chr(10) || chr(10) || '[Output truncated for safety]' ELSE t END AS x, 0 AS n FROM r),
k AS (SELECT doc_id, {' OR '.join(f"regexp_matches(x, '{_quoted(p)}')" for p in G.PROMPT_LEAKS)} AS leak FROM b), {_s2},
c AS (SELECT *, x AS before, {_private('x')} AS y FROM {_a2}), e AS (SELECT doc_id, lang, cut, n AS n_secrets, before <> y AS private, y AS x, 0 AS n FROM c), {_h2},
f AS (SELECT doc_id, lang, cut, n_secrets, private, n AS n_html, x AS before, {_replace('x', _LINKS, chr(92) + '1(#)')} AS x FROM {_ah2}),
g AS (SELECT *, list_filter(list_transform(regexp_split_to_array(x, '\r?\n'), lambda l: trim(l)), lambda l: l <> '') AS l FROM f),
h AS (SELECT *, len(l) >= 6 AND list_sum(list_transform(list_distinct(l), lambda y: length(y))) / list_sum(list_transform(l, lambda y: length(y))) < 0.55 AS loop FROM g),
o AS (SELECT *, CASE WHEN loop THEN 'excessive_repetition' WHEN trim(x, {_blank}) = '' THEN 'empty_after_filtering' END AS why FROM h JOIN k USING (doc_id))
SELECT doc_id, CASE WHEN leak OR why IS NOT NULL THEN {_refusal} ELSE trim(x, {_blank}) END AS answer, leak OR why IS NOT NULL AS blocked,
CASE WHEN leak THEN 'prompt_leak' ELSE concat_ws(',', CASE WHEN cut THEN 'safety_length_truncation' END, CASE WHEN n_secrets > 0 THEN 'secret_redaction' END, CASE WHEN private THEN 'pii_redaction' END, CASE WHEN n_html > 0 THEN 'html_sanitized' END, CASE WHEN x <> before THEN 'unsafe_links_sanitized' END, why) END AS reasons FROM o""")
def output_filter(spark, d):
    rows = risky(spark, d).select("doc_id", G.filter_output(F.col("text"), F.upper("lang")).alias("r"))
    return rows.select("doc_id", "r.answer", "r.blocked", F.array_join("r.reasons", ",").alias("reasons"))


def _cleaned(x: str) -> str:
    for p in G.SECRETS:
        x = _replace(x, p)
    return x


def _shown(x: str) -> str:
    x = _private(_cleaned(x))
    for p in G.HTML:
        x = _replace(x, p, "")
    return _replace(x, _LINKS, chr(92) + "1(#)")


@query(rf"""WITH {ANSWERS}, p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, {_blank})), lambda x: x <> '') AS l FROM answers),
s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l)))::INTEGER AS pos FROM p), k AS (SELECT *, {' OR '.join(f"regexp_matches(s, '{_quoted(p)}')" for p in G.PROMPT_LEAKS)} AS halted FROM s)
SELECT doc_id, pos, CASE WHEN halted THEN '' ELSE {_shown('s')} END AS text, halted FROM k""")
def streamed_sentences(spark, d):
    rows = cited_answers(spark, d).select("doc_id", F.posexplode(W.sentences(F.col("answer"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", G.redact_sentence(F.col("s")).alias("r")).select("doc_id", "pos", "r.text", "r.halted")


@query(f"SELECT doc_id, {_private(_cleaned('text'))} AS text FROM (SELECT doc_id, {RISKY} AS text FROM documents WHERE text IS NOT NULL)")
def trace_mask(spark, d):
    return risky(spark, d).select("doc_id", G.mask_trace(X.nfkc(F.col("text"))).alias("text"))
