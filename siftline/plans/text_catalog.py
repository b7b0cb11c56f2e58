"""Queries on text, chunks, layout, files, and whole retrieval runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftline import providers as P
from siftline.functions import text as X
from siftline.functions import vector as V
from siftline.functions.columns import few
from siftline.operators import cached as CR
from siftline.operators import chunking as K
from siftline.operators import generator as GN
from siftline.operators import keyword_index as N
from siftline.operators import layout as Y
from siftline.operators import ranking as R
from siftline.operators import retrieval as Q
from siftline.operators import vector_index as I
from siftline.plans.registry import POOL, pool, query
from siftline.sources import pdf
from siftline.sources import tables as T
from siftline.sources.shared import kept, shared_path
from siftline.sources.tables import table

_count = lambda k, p: " + ".join(f"(length({p}) - length(replace({p}, '{w}', ''))) / {len(w)}" for w in X.LANGUAGE_KEYWORDS[k])
_UNEXPECTED = X.UNEXPECTED.replace("'", "''")


def detected(text: str) -> str:
    """SQL of the detected language as a list: language, confident, score; each keyword counted without overlaps."""
    parts = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"
    garbled = f"((len({parts}) >= 8 AND len(list_filter({parts}, lambda x: length(x) = 1)) / len({parts})::DOUBLE > 0.3) OR (length({text}) >= 24 AND len(regexp_extract_all({text}, '{_UNEXPECTED}')) / length({text})::DOUBLE > 0.12))"
    counts = ", ".join(f"CAST({_count(k, 'p')} AS INTEGER)" for k in X.LANGUAGE_KEYWORDS)
    return f"(SELECT CASE WHEN {garbled} THEN [0, 0, 0, 0, 0] ELSE [{counts}] END FROM (SELECT ' ' || lower({text}) || ' ' AS p))"


_LANGS = "['" + "', '".join(X.LANGUAGE_KEYWORDS) + "']"
DETECTED = f"""padded AS (SELECT *, ' ' || lower(text) || ' ' AS p, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
counted AS (SELECT * EXCLUDE (p, w), CASE WHEN (len(w) >= 8 AND len(list_filter(w, lambda x: length(x) = 1)) / len(w)::DOUBLE > 0.3) OR (length(text) >= 24 AND len(regexp_extract_all(text, '{_UNEXPECTED}')) / length(text)::DOUBLE > 0.12) THEN [0, 0, 0, 0, 0] ELSE [{", ".join(f"CAST({_count(k, 'p')} AS INTEGER)" for k in X.LANGUAGE_KEYWORDS)}] END AS c FROM padded),
detected AS (SELECT * EXCLUDE (c), CASE WHEN list_max(c) > 0 THEN {_LANGS}[list_position(c, list_max(c))] ELSE 'EN' END AS language, list_max(c) > 0 AND len(list_filter(c, lambda x: x = list_max(c))) = 1 AS confident, list_max(c) AS score FROM counted)"""


@query(f"WITH {DETECTED} SELECT doc_id, language, confident, score FROM detected")
def lang_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", X.detect_language(F.col("text")).alias("x")).select("doc_id", "x.language", "x.confident", "x.score")


@query(f"WITH {DETECTED} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'FR' WHEN score > 0 THEN language ELSE 'EN' END AS language FROM detected")
def query_language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.query_language(F.col("text"), F.when(F.col("doc_id") % 3 == 0, "FR")).alias("language"))


SECTIONED = f"""{DETECTED}, s AS (SELECT doc_id // 20 AS doc, doc_id, language, confident FROM detected),
v AS (SELECT doc, language, count(*) AS n, min(doc_id) AS f FROM s WHERE confident GROUP BY 1, 2), m AS (SELECT doc, arg_max(language, (n, -f)) AS most FROM v GROUP BY 1)"""


@query(f"WITH {SECTIONED} SELECT s.doc AS doc_id, s.doc_id AS section, CASE WHEN confident THEN language ELSE coalesce(most, 'EN') END AS language FROM s LEFT JOIN m USING (doc)")
def section_languages(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.floor(i / 20).alias("doc_id"), i.alias("section"), "text")
    return K.section_languages(rows).select("doc_id", "section", "language")


@query(f"WITH {SECTIONED}, n AS (SELECT s.doc_id AS chunk_id, upper(d.lang) AS old, CASE WHEN confident THEN language ELSE coalesce(CASE WHEN s.doc % 2 = 0 THEN 'IT' END, most, 'EN') END AS new, CASE WHEN confident THEN 'detected' ELSE 'inherited' END AS reason FROM s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN m USING (doc)) SELECT * FROM n WHERE new IS DISTINCT FROM old")
def backfill_languages(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("chunk_id"), F.floor(i / 20).alias("document_id"), i.alias("ord"), F.lit("").alias("title"), F.col("text").alias("content"), F.upper("lang").alias("language"))
    docs = rows.select("document_id").distinct().withColumn("language", F.when(F.col("document_id") % 2 == 0, "IT"))
    return K.backfill_languages(rows, docs)


@query(rf"""WITH q AS (SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 0 ELSE 0.55 * len(regexp_extract_all(text, '\p{{L}}')) / length(text)::DOUBLE + 0.35 * len(regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{P}}\p{{Zs}}]')) / length(text)::DOUBLE + 0.1 * (1 - len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{P}}\p{{Zs}}]')) / length(text)::DOUBLE) END AS q FROM documents)
SELECT doc_id, trim(text) = '' OR len(regexp_extract_all(text, '{_UNEXPECTED}')) / length(text)::DOUBLE > 0.12 OR q < 0.58 OR len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 1)) < 4 AS low FROM q""")
def low_readability(spark, d):
    return table(spark, d, "documents").select("doc_id", X.low_readability(F.col("text")).alias("low"))


_asks = r"\b(?:" + "|".join(X.OVERVIEW).replace("'", "''") + r")\b"
_ASKED = "CASE turn % 4 WHEN 0 THEN 'Please summarize this document' WHEN 1 THEN CASE conv_id % 2 WHEN 0 THEN 'Gib mir einen Überblick' ELSE 'Fasse das bitte zusammen' END WHEN 2 THEN text ELSE 'worum geht es hier?' END"


@query(f"SELECT conv_id, turn, conv_id % 3 > 0 AND regexp_matches(lower(trim(regexp_replace({_ASKED}, '\\s+', ' ', 'g'))), '{_asks}') AS overview FROM conversations")
def overview_intent(spark, d):
    one = F.when(F.col("conv_id") % 3 > 0, F.array("conv_id")).otherwise(F.array("conv_id", "turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.overview_intent(X.normalize_query(F.expr(_ASKED)), one).alias("overview"))


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS x FROM documents), o AS (SELECT *, list_slice(list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND length(y) <= 120 AND regexp_matches(y, '^(?:\d+(?:\.\d+)*\s+)?[A-ZÀ-Ü]')), 1, 60) AS o FROM c)
SELECT doc_id, CASE WHEN length(x) <= 6000 THEN trim(regexp_replace(x, '\s+', ' ', 'g')) ELSE left(x, 4000) || CASE WHEN len(o) > 0 THEN chr(10) || chr(10) || 'Section outline:' || chr(10) || array_to_string(o, chr(10)) ELSE '' END || chr(10) || chr(10) || 'Document ending:' || chr(10) || right(x, 2000) END AS excerpt, coalesce(length(x) BETWEEN 16000 AND 400000, false) AS cacheable FROM o""")
def excerpt(spark, d):
    x = F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r"^\s+|\s+$", "")
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"), X.cacheable(x).alias("cacheable"))


@query("SELECT doc_id, coalesce(upper(lang), '') || chr(10) || coalesce(source, '') || chr(10) || '' || chr(10) || '' || chr(10) || coalesce(text, '') AS input FROM documents")
def embed_input(spark, d):
    return table(spark, d, "documents").select("doc_id", K.embed_input(F.upper("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("input"))


@query(r"""WITH t AS (SELECT item_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS t FROM benchmark), q AS (SELECT item_id, list_slice(list_filter(t, lambda x, i: length(x) >= 2 AND list_position(t, x) = i), 1, 32) AS q FROM t),
w AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')), lambda x: x <> '') AS w FROM documents WHERE doc_id % 50 = 0),
p AS (SELECT item_id, doc_id, q, w FROM q, w) SELECT item_id, doc_id, round(len(list_filter(q, lambda t: list_contains(w, t) OR (length(t) >= 5 AND len(list_filter(w, lambda x: starts_with(x, t) OR starts_with(t, x))) > 0))) / len(q)::DOUBLE, 6) AS overlap FROM p WHERE len(q) > 0 AND w IS NOT NULL""")
def lexical_overlap(spark, d):
    """Every question against the stated set, the documents whose id is divisible by 50."""
    docs = table(spark, d, "documents").where("doc_id % 50 = 0 and text is not null").select("doc_id", "text")
    return R.lexical_overlaps(table(spark, d, "benchmark").select("item_id", "text"), docs).withColumn("overlap", F.round("overlap", 6))


@query("SELECT doc_id, list_contains(['DE', 'FR', 'IT', 'ES'], upper(lang)) AS own, CASE upper(lang) WHEN 'DE' THEN 'german' WHEN 'FR' THEN 'french' WHEN 'IT' THEN 'italian' WHEN 'ES' THEN 'spanish' ELSE 'english' END AS config FROM documents WHERE lang IS NOT NULL")
def search_config(spark, d):
    return table(spark, d, "documents").where("lang is not null").select("doc_id", F.upper("lang").isin(*X.SEARCH_CONFIG).alias("own"), X.search_config(F.upper("lang")).alias("config"))


_stem = lambda w, c: f"regexp_replace({w}, '{X.ENDINGS[c]}', '\\1')"
LEXEMES = rf"""words AS (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(coalesce(source, '') || ' ' || coalesce(text, '') || ' ' || coalesce(lang, '')), '[^\p{{L}}\p{{N}}]+')) AS w FROM documents),
lex AS (SELECT doc_id, w AS t FROM words WHERE w <> '' UNION ALL SELECT doc_id, CASE upper(coalesce(lang, '')) WHEN 'DE' THEN {_stem('w', 'german')} WHEN 'FR' THEN {_stem('w', 'french')} WHEN 'IT' THEN {_stem('w', 'italian')} WHEN 'ES' THEN {_stem('w', 'spanish')} ELSE {_stem('w', 'english')} END FROM words WHERE w <> ''),
asked AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM benchmark),
ql AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest([w, {", ".join(_stem('w', c) for c in X.ENDINGS)}]) AS t FROM asked WHERE w <> '') WHERE length(t) >= 3),
lrank AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(count(*) * 0.1::DOUBLE, 6) AS rank FROM lex JOIN ql USING (t) GROUP BY 1, 2)"""


@query(f"WITH {LEXEMES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, chunk_id) AS ord FROM lrank) SELECT query_id, chunk_id, rank, CAST(ord AS INTEGER) AS ord FROM r WHERE ord <= 20")
def lexeme_topk(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("context"), F.upper("lang").alias("language"))
    return R.lexeme_topk(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), rows, 20)


@query(r"""WITH n AS (SELECT page_id, trim(regexp_replace(lower(trim(regexp_replace(url, '(?i)\.pdf$', ''))), '[^a-z0-9]+', '-', 'g'), '-') AS s, url FROM pages)
SELECT page_id, 'uploads/' || sha256(url) || '-' || CASE WHEN s = '' THEN 'document' ELSE left(s, 48) END || '.pdf' AS path, sha256(url) || ':v' || (page_id % 3) AS key, lower(url) LIKE '%.pdf' OR page_id % 2 = 0 AS pdf, CASE WHEN page_id % 5 < 2 THEN 'DE' END AS hint FROM n""")
def upload_names(spark, d):
    i, sha = F.col("page_id"), F.sha2("url", 256)
    hint = F.when(i % 5 == 0, " de ").when(i % 5 == 1, "DE").when(i % 5 == 2, "xx").otherwise("")
    return table(spark, d, "pages").select("page_id", X.storage_path(sha, F.col("url")).alias("path"), X.idempotency_key(sha, i % 3).alias("key"), X.looks_like_pdf(F.col("url"), F.when(i % 2 == 0, "application/pdf").otherwise("text/html")).alias("pdf"), X.language_hint(hint).alias("hint"))


@query("SELECT item_id, sha256(text || '::' || 'EN' || '::v' || 1 || '::k' || (item_id % 9) || '::scope' || (item_id % 4) || '::cfg' || left(sha256('ce:true|pool:100'), 12) || '::schema2') AS key FROM benchmark")
def cache_keys(spark, d):
    i = F.col("item_id")
    config = F.lit(X.config_fingerprint({"ce": True, "pool": 100}))
    return table(spark, d, "benchmark").select("item_id", X.cache_key(F.col("text"), F.lit("EN"), F.lit(1), i % 9, (i % 4).cast("string"), config).alias("key"))


_RAW = "CASE doc_id % 4 WHEN 0 THEN 'Sure: [\"One ' || doc_id || '\", \" two\", \"\", \"TWO\", \"three\"] done' WHEN 1 THEN 'no list' WHEN 2 THEN '[broken' ELSE '[\"only\"]' END"


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'q|one ' || doc_id || '|two|three' WHEN 3 THEN 'q|only' ELSE 'q' END AS varied, CASE WHEN doc_id % 4 = 0 THEN 'One ' || doc_id || '|two|three' ELSE '' END AS parts FROM documents")
def model_lists(spark, d):
    raw = F.expr(_RAW)
    return table(spark, d, "documents").select("doc_id", F.array_join(X.variations(raw, F.lit("q")), "|").alias("varied"), F.array_join(X.sub_queries(raw, F.lit("q")), "|").alias("parts"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform([' ' || source, lang || ' ', '', lang, NULL], lambda x: trim(x)), lambda x: x <> ''))), ',') AS scope FROM documents")
def scopes(spark, d):
    ids = F.array(F.concat(F.lit(" "), "source"), F.concat("lang", F.lit(" ")), F.lit(""), F.col("lang"), F.lit(None).cast("string"))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.scope(ids), ",").alias("scope"))


@query(r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '').len() >= 12 AS long FROM documents WHERE text IS NOT NULL")
def decomposition_guard(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.decomposes(F.col("text")).alias("long"))


_depth = r"CASE WHEN x <> '' AND length(x) <= 120 AND NOT regexp_matches(x, '^\|.*\|$') AND ((regexp_full_match(x, '%s') AND regexp_matches(x, '[A-ZÄÖÜ]')) OR regexp_full_match(x, '%s')) THEN CASE WHEN regexp_matches(x, '^\d+(\.\d+)*\s') THEN len(string_split(regexp_extract(x, '^(\d+(?:\.\d+)*)\s', 1), '.')) WHEN regexp_full_match(x, '%s') AND regexp_matches(x, '[A-ZÄÖÜ]') THEN 1 ELSE 2 END ELSE 0 END" % (K.CAPITALS, K.TITLE, K.CAPITALS)
HEADED = "CASE doc_id % 5 WHEN 0 THEN 'OVERVIEW' WHEN 1 THEN '5.4 Mutationen And Changes' WHEN 2 THEN '| A | B |' WHEN 3 THEN '2024 2025 2026' ELSE 'Data Of The Year' END"


@query(f"WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, '') || chr(10) || {HEADED}, chr(10)))) AS x FROM documents), k AS (SELECT doc_id, {_depth} AS depth FROM l) SELECT doc_id, count(*) FILTER (depth > 0) AS headings, CAST(sum(depth) AS BIGINT) AS depths FROM k GROUP BY 1")
def heading_depths(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(HEADED)), "\n")).alias("x"))
    rows = lines.select("doc_id", K.heading_depth(F.col("x")).alias("depth"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("depth") > 0).alias("headings"), F.sum("depth").alias("depths"))


@query("SELECT doc_id // 50 AS doc_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY doc_id // 50 ORDER BY n_chars % 3, doc_id) - 1 AS INTEGER) AS chunk_index FROM documents")
def reindexed(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.floor(i / 50).alias("doc_id"), i.alias("chunk_id"), (F.col("n_chars") % 3).alias("run"), i.alias("chunk_index"))
    return K.reindex(rows).select("doc_id", "chunk_id", "chunk_index")


def paged(spark, d):
    """The documents as pages of one document each, every fifth with a heading and a table."""
    extra = F.when(F.col("doc_id") % 5 == 0, F.lit("\n\nRESULTS OF THE YEAR\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n- one point\n- another")).otherwise(F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.concat("text", extra).alias("text"))


@query()
def sections(spark, d):
    return K.sections(paged(spark, d))


@query()
def chunk_pack(spark, d):
    return K.chunk_documents(paged(spark, d))


def placed(spark, d):
    """Pages of items: words of each document's begin on lines, and rows of lineitem as tables."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.array(*(F.struct(F.col(c).cast("string").alias("text"), F.lit(100.0 * k).alias("x"), (700.0 - 20.0 * F.col("l_linenumber")).alias("y"), (6.0 * F.length(F.col(c).cast("string"))).alias("width")) for k, c in enumerate(("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))).alias("items"))
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "items"))).alias("l"))
    return g.select("doc_id", F.lit(1).alias("page"), F.flatten(F.col("l.items")).alias("items"))


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_suppkey || ' | ' || l_returnflag || ' |' AS tab, l_linenumber || ' ' || l_partkey || ' ' || l_suppkey || ' ' || l_returnflag AS flat, count(*) OVER (PARTITION BY l_orderkey) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem)
SELECT doc_id, string_agg(CASE WHEN k >= 3 THEN tab || CASE WHEN i = 1 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END ELSE flat END, chr(10) ORDER BY n, tab) AS text, bool_or(k >= 3) AS has_tables FROM r GROUP BY 1 HAVING count(DISTINCT n) = count(*) AND max(n) - min(n) + 1 = count(*)""")
def table_layout(spark, d):
    """Orders whose lines are numbered without gaps or repeats as one table each."""
    whole = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("u"), F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b")).where("n = u and b - a + 1 = n")
    return Y.assemble_pages(placed(spark, d).join(whole.select("doc_id"), "doc_id", "left_semi")).select("doc_id", "text", "has_tables")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def pdf_scrape(spark, d):
    """Files made of the documents' letters, read back by their text operators."""
    letters = F.regexp_replace("text", "[^a-z ]", "")
    data = F.concat(F.lit("%PDF-1.4\n1 0 obj BT ("), letters, F.lit(") Tj ET endobj"))
    files = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), data.cast("binary").alias("content"))
    return pdf.pages(files).select(F.col("path").cast("long").alias("doc_id"), "text")


CHUNK_JSON = """'[{"content": "c' || doc_id || '", "page_number": ' || (doc_id % 9) || ', "section_title": ""}, {"chunk_index": 7, "content": null, "section_title": "s", "language": "DE", "embedding": [1, 2.5]}]'"""


@query("""SELECT doc_id, unnest([0, 7]) AS chunk_index, unnest([doc_id % 9, 1])::INTEGER AS page_number, unnest([NULL, 's']) AS section_title, unnest(['c' || doc_id, '']) AS content, unnest(['EN', 'DE']) AS language, unnest([0, 2]) AS dims FROM documents""")
def chunk_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(CHUNK_JSON.replace("'[{", "'[{")).alias("payload"))
    done = T.chunk_rows(rows, "payload")
    return done.select("doc_id", "chunk_index", "page_number", "section_title", "content", "language", F.size("embedding").alias("dims"))


_listed = lambda c: "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS[c]) + "]"
_config = "CASE upper(coalesce(lang, '')) WHEN 'DE' THEN 'german' WHEN 'FR' THEN 'french' WHEN 'IT' THEN 'italian' WHEN 'ES' THEN 'spanish' ELSE 'english' END"
_stems = " ".join(f"WHEN '{c}' THEN CASE WHEN NOT list_contains({_listed(c)}, w) THEN {_stem('w', c)} END" for c in X.ENDINGS)
COVERS = rf"""texts AS (SELECT doc_id, {_config} AS config, list_filter(regexp_split_to_array(lower(coalesce(source, '') || ' ' || coalesce(text, '') || ' ' || coalesce(lang, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
cwords AS (SELECT doc_id, config, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
clex AS (SELECT doc_id, 0 AS copy, w AS t, least(i, {N.LAST}) AS p FROM cwords UNION ALL SELECT doc_id, 1, CASE config {_stems} END, least(least(i, {N.LAST}) + least(n, {N.LAST}), {N.LAST}) FROM cwords),
cpos AS (SELECT DISTINCT doc_id, copy, t, p FROM clex WHERE t IS NOT NULL),
ccap AS (SELECT *, row_number() OVER (PARTITION BY doc_id, copy, t ORDER BY p) AS k FROM cpos),
call_ AS (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id, t ORDER BY p) AS k FROM (SELECT DISTINCT doc_id, t, p FROM ccap WHERE k <= {N.IN_COPY})),
cq AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, w AS t FROM asked UNION ALL {" UNION ALL ".join(f"SELECT item_id, {_stem('w', c)} FROM asked WHERE NOT list_contains({_listed(c)}, w)" for c in X.ENDINGS)}) WHERE length(t) >= 3),
crank AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(count(DISTINCT p) * 0.1::DOUBLE, 6) AS rank FROM call_ JOIN cq USING (t) WHERE k <= {N.IN_ALL} GROUP BY 1, 2)"""


def cover_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("text").alias("content"), F.col("lang").alias("context"), F.upper("lang").alias("language"))


@query(f"WITH {LEXEMES}, {COVERS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, chunk_id) AS ord FROM crank) SELECT query_id, chunk_id, rank, CAST(ord AS INTEGER) AS ord FROM r WHERE ord <= 20")
def cover_topk(spark, d):
    return N.keyword_search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), cover_chunks(spark, d), 20)


@query()
def cover_all_topk(spark, d):
    """All words of the first sentence of each benchmark item, over an index that is built before."""
    path = shared_path(spark, "keyword-index")
    N.build(cover_chunks(spark, d), path)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring_index("text", ".", 1).alias("text"))
    return N.cover_topk(N.all_of(q), N.opened(spark, path), 20)


@query("SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def vector_parse(spark, d):
    text = F.concat(F.lit("[nan, "), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", "), F.lit(", x]"))
    rows = table(spark, d, "embeddings").select("vec_id", V.parse(text).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200")
def recent_sample(spark, d):
    return T.most_recent(table(spark, d, "events"), "ts", "event_id", 200).select("event_id", "ts")


@query("SELECT page_id, url, left(html, 500) AS snippet FROM pages WHERE regexp_matches(url, '(?i)^https?://') AND (page_id % 10) / 9.0::DOUBLE >= 0.5")
def web_sources(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", F.col("html").alias("content"), ((F.col("page_id") % 10) / 9).alias("score"))
    return T.web_sources(rows).select("page_id", "url", "snippet")


def corpus(spark, d):
    """The documents as chunks of twenty to a document, embedded by hashed words."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select(i.alias("chunk_id"), F.floor(i / 20).alias("document_id"), (i % 20).cast("int").alias("page"), F.col("source").alias("title"), text.alias("content"), F.lit(None).cast("string").alias("context"), F.upper("lang").alias("language"))
    return rows.withColumn("embedding", P.HashedWords().embed(F.col("content")))


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query()
def retrieve_batch(spark, d):
    return Q.retrieve(asked(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "ord", F.round("relevance", 6).alias("relevance"))


@query()
def route_batch(spark, d):
    return Q.expand(asked(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "ord")


@query()
def decompose_batch(spark, d):
    return Q.decompose(asked(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "ord")


@query()
def mixed_route_batch(spark, d):
    """Every third question is expanded; long ones are taken apart; all others are retrieved as they are."""
    q = asked(spark, d).withColumn("expand", F.col("query_id") % 3 == 0)
    return Q.route(q, corpus(spark, d)).rows.select("query_id", "chunk_id", "ord")


@query()
def web_answer_batch(spark, d):
    """Answers of questions that have pages as web sources beside their chunks."""
    q, n = asked(spark, d), F.col("page_id")
    web = table(spark, d, "pages").where("url is not null").select((n % 20).alias("query_id"), F.row_number().over(Window.partitionBy(n % 20).orderBy("page_id")).alias("ord"), F.col("url").alias("title"), "url", F.left("html", F.lit(500)).alias("snippet")).where("ord <= 5")
    return Q.answer(q, Q.retrieve(q, corpus(spark, d)), web=web).select("query_id", "answer", "outcome", "n_web", "suspicious_web", "blocked_web", "verdict")


def generator_chunks(spark, d):
    c = corpus(spark, d).drop("embedding").where("language is not null")
    return c.withColumns({"ord": F.col("page"), "document_id": F.col("document_id") * 10 + F.ascii("language") % 10})


@query("""WITH c AS (SELECT doc_id, upper(lang) AS language, doc_id // 20 * 10 + ascii(upper(lang)) % 10 AS document, row_number() OVER (PARTITION BY doc_id // 20 * 10 + ascii(upper(lang)) % 10 ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY doc_id // 20 * 10 + ascii(upper(lang)) % 10) AS n
FROM documents WHERE lang IS NOT NULL AND length(trim(coalesce(text, ''))) >= 200), k AS (SELECT *, least(10, greatest(3, (n + 5) // 6)) AS k FROM c)
SELECT language, document, doc_id AS chunk_id FROM k WHERE r IN (SELECT unnest(list_transform(range(k), lambda i: i * n // k)))""")
def generated_single_hop(spark, d):
    """The chunks that questions are made of, evenly spaced in each document."""
    return GN.single_hop(generator_chunks(spark, d), GN.PlainWriter()).select("language", "document", F.get("chunk_ids", 0).alias("chunk_id"))


@query()
def generated_benchmark(spark, d):
    """The figures of a benchmark run over generated multi-hop and unanswerable questions against the whole corpus."""
    rows = generator_chunks(spark, d)
    golden = kept(GN.golden(GN.multi_hop(rows, GN.PlainWriter()).unionByName(GN.unanswerable(rows, GN.PlainWriter(), {"EN": 8, "DE": 7}))), "golden")
    chunks = corpus(spark, d).withColumn("document_id", F.col("document_id") * 10 + F.coalesce(F.ascii("language") % 10, F.lit(0)))
    return Q.evaluated(golden, chunks).select("query_id", "language", "question_type", "recall_at_5", "mrr", "insufficient")


@query()
def corrective(spark, d):
    return Q.correct(asked(spark, d), corpus(spark, d)).select("query_id", "chunk_id", "ord", F.round("relevance", 6).alias("relevance"))


@query()
def answer_batch(spark, d):
    q = asked(spark, d)
    return Q.answer(q, Q.retrieve(q, corpus(spark, d))).select("query_id", "answer", "outcome", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "verdict")


@query()
def overview_batch(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" What is this document about")).alias("text"), F.array(F.col("item_id").cast("long")).alias("scope"))
    return Q.overview(q, corpus(spark, d)).select("query_id", "document_id", "chunk_id", "score")


@query(r"""WITH n AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark) SELECT item_id AS query_id, t IN (SELECT t FROM n WHERE item_id % 2 = 0) AS cache_hit, 8::BIGINT AS n FROM n WHERE t <> ''""")
def cached_retrieval(spark, d):
    """Every second question first, then all of them against the cache that this left."""
    q, chunks = asked(spark, d), corpus(spark, d)
    first = CR.retrieve(q.where("query_id % 2 = 0"), chunks, CR.empty(spark), "2024-01-01")
    return CR.retrieve(q, chunks, first.cache, "2024-01-01 00:10:00").trace.select("query_id", "cache_hit", "n")


@query("""WITH p AS (SELECT query_id, count(*) AS n FROM (SELECT CASE WHEN doc_id // 50 % 4 = 1 THEN 1000000000 + doc_id // 2 ELSE doc_id // 50 END AS query_id FROM documents) GROUP BY 1) SELECT query_id, n, greatest(0, n - 20) AS omitted FROM p""")
def compact_lists(spark, d):
    return Q.compact(pool(spark, d))[1]


@query(f"WITH {POOL} SELECT query_id, CAST(ord AS INTEGER) AS ord, chunk_id, document_id, page, title, score, scale FROM listed WHERE ord <= 20")
def compact_rows(spark, d):
    return Q.compact(pool(spark, d))[0]


def index_of(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return I.build(rows, shared_path(spark, "vector-index"))


def index_queries(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def ivf_topk(spark, d):
    """The probed lists alone; its recall against the exact search is tested."""
    return I.search(index_of(spark, d), index_queries(spark, d), 10)


@query("""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS ord FROM s) SELECT query_id, chunk_id, similarity, CAST(ord AS INTEGER) AS ord FROM r WHERE ord <= 10""")
def ivf_exact_topk(spark, d):
    return I.search(index_of(spark, d), index_queries(spark, d), 10, exact=True)
