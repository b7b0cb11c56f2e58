"""Text scalars as Column functions: normalisation, tokens, language, readability, excerpts, sanitising."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .columns import let

# Keywords by language, in the order that decides ties.
LANGUAGE_KEYWORDS = {
    "DE": [" und ", " der ", " die ", " das ", " des ", " für ", " fuer ", " mit ", " ich ", " ist ", " ein ", " eine ", " einen ", " nicht ", " von ", " sich ", " auf "],
    "FR": [" le ", " la ", " les ", " des ", " pour ", " avec "],
    "IT": [" il ", " lo ", " gli ", " per ", " con ", " della "],
    "ES": [" el ", " la ", " los ", " para ", " con ", " del "],
    "EN": [" the ", " and ", " for ", " with ", " from ", " this "],
}
# What ordinary text consists of, and words that ask for an overview of a document.
UNEXPECTED = r"""[^\p{L}\p{N}\p{Zs}.,;:!?()"'%/&+\-–—§@#*\[\]€$]"""
OVERVIEW = (
    r"summari[sz]e", "summary", "overview", "main points?", "what is (?:this|the) document about", "what are the contents? of (?:this|the) document", "what is the content of (?:this|the) document",
    "what does (?:this|the) document contain", "please summarize", r"zusammenfass\w*", r"fass(?:e|en)\b.*\bzusammen", "überblick", "worum geht es", "was ist der inhalt", "was sind die inhalte",
    "was steht in (?:diesem|dem) dokument", "r[ée]sum[ée]", "r[ée]sume(?:r|z)", "contenu du document", "de quoi parle (?:ce|le) document", "vue d['’]ensemble", "sintesi", "riassum(?:i|ere)",
    "contenuto del documento", "di cosa parla (?:questo|il) documento", "panoramica", "resumen", "resum(?:e|ir)", "contenido del documento", "de qu[ée] trata (?:este|el) documento", "visi[óo]n general",
)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_query(q: Column, compatible: bool = False) -> Column:
    """Lower case, white space collapsed and trimmed; compatible: the text is in NFKC already, which saves the Python pass."""
    return F.lower(F.trim(F.regexp_replace(q if compatible else nfkc(q), r"(?U)\s+", " ")))


def query_tokens(q: Column, least: int = 2, most: int = 32) -> Column:
    """The first `most` distinct runs of letters and digits of `least` characters or more, in lower case."""
    return F.slice(F.array_distinct(F.filter(F.split(F.lower(q), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)), 1, most)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _counted(padded: Column, language: str) -> Column:
    return sum((F.regexp_count(padded, F.lit(k)) for k in LANGUAGE_KEYWORDS[language]), F.lit(0)).cast("int")


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def keyword_count(text: Column, language: str) -> Column:
    """How often the language's keywords occur, without overlaps."""
    return let(_padded(text), lambda p: _counted(p, language))


def garbled(text: Column) -> Column:
    """Character-spaced or badly decoded text, whose keyword hits mean nothing."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    spaced = let(parts, lambda x: (F.size(x) >= 8) & (F.size(F.filter(x, lambda t: F.length(t) == 1)) / F.size(x) > 0.3))
    return spaced | ((F.length(text) >= 24) & (F.regexp_count(text, F.lit(UNEXPECTED)) / F.length(text) > 0.12))


def detect_language(text: Column) -> Column:
    """A struct (language, confident, score): the first language with the most keyword hits; EN without any; a tie isn't confident."""
    counts = F.when(F.coalesce(~garbled(text), F.lit(False)), let(_padded(text), lambda p: F.array(*(_counted(p, k) for k in LANGUAGE_KEYWORDS)))).otherwise(F.array(F.lit(0)))

    def decided(c: Column) -> Column:
        best = F.array_max(c)
        first = F.get(F.array(*map(F.lit, LANGUAGE_KEYWORDS)), F.array_position(c, best).cast("int") - 1)
        alone = F.size(F.filter(c, lambda x: x == best)) == 1
        return F.struct(F.when(best > 0, first).otherwise(F.lit("EN")).alias("language"), ((best > 0) & alone).alias("confident"), best.alias("score"))

    return let(counts, decided)


def text_quality(text: Column) -> Column:
    """Share of letters, printable and odd characters, weighted; 0 for blank text. Expects NFKC."""
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.length(text)
    score = 0.55 * share(r"\p{L}") + 0.35 * share(r"[\p{L}\p{N}\p{P}\p{Zs}]") + 0.1 * (1 - share(r"[^\p{L}\p{N}\p{P}\p{Zs}]"))
    return F.when(F.trim(text) == "", 0.0).otherwise(score)


def low_readability(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: F.length(t) > 1))
    return (F.trim(text) == "") | (F.regexp_count(text, F.lit(UNEXPECTED)) / F.length(text) > 0.12) | (text_quality(text) < 0.58) | (words < 4)


#: Where a word begins or ends: its characters are A-Z, a-z, digits and the underscore, so an umlaut at its edge is none.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def overview_intent(query: Column, scope: Column) -> Column:
    return (F.size(scope) == 1) & query.rlike(EDGE + "(?:" + "|".join(OVERVIEW).replace(r"\b", EDGE) + ")" + EDGE)


def lexical_overlap(query: Column, words: Column) -> Column:
    """Share of query tokens that a text token equals, or, if the query token has five characters or more, of which one is
    the other's prefix."""

    def share(x: Column) -> Column:
        hit = lambda t: F.array_contains(x.w, t) | ((F.length(t) >= 5) & F.exists(x.w, lambda y: y.startswith(t) | t.startswith(y)))
        return F.when(F.size(x.q) > 0, F.size(F.filter(x.q, hit)) / F.size(x.q)).otherwise(0.0)

    return let(F.struct(query.alias("q"), words.alias("w")), share)


def excerpt(text: Column, whole: int = 6000, head: int = 4000, tail: int = 2000, lines: int = 60) -> Column:
    """A text up to `whole` characters with single spaces, or its head, lines that look like an outline, and its tail."""

    def cut(x: Column) -> Column:
        short = F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
        outline = F.slice(F.filter(F.transform(F.split(x, "\n"), lambda t: F.trim(t)), lambda y: (y != "") & (F.length(y) <= 120) & y.rlike(r"^(?:\d+(?:\.\d+)*\s+)?[A-ZÀ-Ü]")), 1, lines)
        middle = F.when(F.size(outline) > 0, F.concat(F.lit("\n\nSection outline:\n"), F.array_join(outline, "\n"))).otherwise(F.lit(""))
        return F.when(F.length(x) <= whole, short).otherwise(F.concat(F.left(x, F.lit(head)), middle, F.lit("\n\nDocument ending:\n"), F.right(x, F.lit(tail))))

    return let(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""), cut)


def cacheable(text: Column, least: int = 16_000, most: int = 400_000) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


# A language's text search configuration, and the endings that its light stemmer drops.
SEARCH_CONFIG = {"DE": "german", "FR": "french", "IT": "italian", "ES": "spanish"}
ENDINGS = {
    "english": r"^(.{3,}?)(?:ingly|edly|ing|ed|ies|es|s|ly)$", "german": r"^(.{4,}?)(?:ungen|ern|em|en|er|es|e|n|s)$", "french": r"^(.{4,}?)(?:ement|ations|ation|es|s|e)$",
    "italian": r"^(.{4,}?)(?:zioni|zione|i|e|a|o)$", "spanish": r"^(.{4,}?)(?:ciones|ción|es|os|as|s|o|a|e)$",
}


def search_config(language: Column) -> Column:
    """The configuration that a chunk's words are stemmed by; english for all other languages."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SEARCH_CONFIG.items() for x in kv))[language], F.lit("english"))


def stems(words: Column, config: Column) -> Column:
    """Words without the endings of a configuration: a light stemmer that approximates a full one."""

    def by(name: str) -> Column:
        return F.transform(words, lambda w: F.regexp_replace(w, ENDINGS[name], "$1"))

    out = by("english")
    for name in ("german", "french", "italian", "spanish"):
        out = F.when(config == name, by(name)).otherwise(out)
    return out


def chunk_lexemes(title: Column, content: Column, context: Column, language: Column) -> Column:
    """All words of a chunk, followed by all of them stemmed by its language: a word that both have counts twice."""
    text = F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in (title, content, context)))
    return let(tokens(text), lambda w: F.concat(w, stems(w, search_config(language))))


def query_lexemes(query: Column, least: int = 3) -> Column:
    """Distinct words of a query, plain and stemmed by every configuration, of `least` letters or more."""
    forms = lambda w: F.flatten(F.array(w, *(F.transform(w, (lambda p: lambda x: F.regexp_replace(x, p, "$1"))(p)) for p in ENDINGS.values())))
    return F.array_distinct(F.filter(let(tokens(query), forms), lambda t: F.length(t) >= least))


# Words that a configuration leaves out when it stems. A short list of each language; give a longer one as `words`.
STOPWORDS = {
    "english": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "if", "in", "is", "it", "its", "not", "of", "on", "or", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you"),
    "german": ("aber", "als", "am", "an", "auch", "auf", "aus", "bei", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einem", "einen", "einer", "er", "es", "für", "hat", "ich", "im", "in", "ist", "mit", "nicht", "oder", "sich", "sie", "und", "von", "war", "wie", "wir", "zu", "zum", "zur"),
    "french": ("au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "leur", "mais", "ne", "nous", "on", "ou", "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "son", "sur", "un", "une", "vous"),
    "italian": ("a", "al", "alla", "che", "ci", "come", "con", "da", "dal", "dei", "del", "della", "di", "e", "gli", "i", "il", "in", "la", "le", "lo", "ma", "nel", "non", "o", "per", "più", "se", "si", "sono", "su", "un", "una"),
    "spanish": ("a", "al", "como", "con", "de", "del", "el", "en", "entre", "era", "es", "esta", "este", "la", "las", "lo", "los", "más", "no", "o", "para", "pero", "por", "que", "se", "sin", "su", "sus", "un", "una", "y"),
}


def stopword(word: Column, config: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Whether a configuration leaves the word out."""
    out = F.lit(False)
    for name, own in (words or STOPWORDS).items():
        out = F.when(config == name, word.isin(*own)).otherwise(out)
    return out


def query_forms(query: Column, least: int = 3) -> Column:
    """Distinct lexemes of a query of `least` letters or more: its words, and those that a configuration doesn't leave out, stemmed
    by it; of every configuration."""
    stemmed = [(lambda p, own: lambda w: F.transform(F.filter(w, lambda x: ~x.isin(*own)), lambda x: F.regexp_replace(x, p, "$1")))(ENDINGS[c], STOPWORDS[c]) for c in ENDINGS]
    forms = lambda w: F.flatten(F.array(w, *(f(w) for f in stemmed)))
    return F.array_distinct(F.filter(let(tokens(query), forms), lambda t: F.length(t) >= least))


def query_language(query: Column, hint: Column | None = None) -> Column:
    """The hint, else the leading language if any keyword occurs, else EN."""
    found = detect_language(query)
    own = let(found, lambda x: F.when(x.score > 0, x.language).otherwise(F.lit("EN")))
    return own if hint is None else F.coalesce(hint, own)


def language_hint(value: Column) -> Column:
    x = F.upper(F.trim(value))
    return F.when(x.isin(*LANGUAGE_KEYWORDS), x)


def scope(ids: Column) -> Column:
    """Document ids trimmed, distinct and sorted, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda t: F.trim(t)), lambda x: x != "")))


def file_slug(name: Column, most: int = 48) -> Column:
    x = F.lower(F.trim(F.regexp_replace(name, r"(?i)\.pdf$", "")))
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(x == "", F.lit("document")).otherwise(F.left(x, F.lit(most)))


def storage_path(sha256: Column, name: Column) -> Column:
    return F.concat(F.lit("uploads/"), sha256, F.lit("-"), file_slug(name), F.lit(".pdf"))


def looks_like_pdf(name: Column, mime: Column) -> Column:
    return (mime == "application/pdf") | F.lower(name).endswith(".pdf")


def has_pdf_signature(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.encode(F.lit("%PDF-"), "UTF-8")


def idempotency_key(sha256: Column, version: Column) -> Column:
    return F.concat(sha256, F.lit(":v"), version.cast("string"))


def config_fingerprint(settings: dict[str, object]) -> str:
    """The first twelve digits of SHA-256 over the settings, name:value, in their order."""
    text = "|".join(f"{k}:{str(v).lower() if isinstance(v, bool) else v}" for k, v in settings.items())
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def cache_key(query: Column, language: Column, version: Column, top_k: Column, scope_key: Column, config: Column) -> Column:
    s = lambda c: c.cast("string")
    return F.sha2(F.concat(query, F.lit("::"), language, F.lit("::v"), s(version), F.lit("::k"), s(top_k), F.lit("::scope"), scope_key, F.lit("::cfg"), config, F.lit("::schema2")), 256)


def json_strings(raw: Column) -> Column:
    """The strings of the first JSON list in a model's answer, trimmed and not empty; null if there is none that can be read."""
    found = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*?\])", 1), "array<string>")
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda x: F.coalesce(x != "", F.lit(False)))


def variations(raw: Column, query: Column, most: int = 3) -> Column:
    """The query and up to `most` different variations of it from a model's answer, in lower case; the query alone if the answer
    can't be read."""
    own = F.coalesce(F.transform(json_strings(raw), F.lower), F.array().cast("array<string>"))
    new = F.array_distinct(F.filter(own, lambda x: x != F.lower(query)))
    return F.concat(F.array(query), F.slice(new, 1, most))


def sub_queries(raw: Column, query: Column, most: int = 3) -> Column:
    """Two or more different parts of a question from a model's answer, as written; none if there are fewer."""
    own = F.coalesce(json_strings(raw), F.array().cast("array<string>"))

    def distinct(a: Column) -> Column:
        low = F.transform(a, F.lower)
        return F.filter(a, lambda x, i: (F.lower(x) != F.lower(F.trim(query))) & (F.array_position(low, F.lower(x)) == i + 1))

    return let(distinct(own), lambda a: F.when(F.size(a) >= 2, F.slice(a, 1, most)).otherwise(F.array().cast("array<string>")))


def decomposes(query: Column, least: int = 12) -> Column:
    """Whether a question is long enough to be taken apart."""
    return F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")) >= least


def sanitize(text: Column) -> Column:
    """Control characters to spaces, runs of blanks to one, more than one blank line to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def html_to_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def repetitive(text: Column) -> Column:
    """Six lines or more of which the distinct ones are less than 0.55 of the characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return (F.size(lines) >= 6) & (chars(F.array_distinct(lines)) / chars(lines) < 0.55)
