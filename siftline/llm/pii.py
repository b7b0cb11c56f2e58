"""Personal data by weak supervision, with DataFrame operations only.

Strict patterns give the base spans, looser ones further candidates. Labelers vote on every candidate: its pattern's own
checks, gazetteers (top-level domains, issuer numbers, reserved networks, area codes), cue words before it, its borders and
the form in which such data is usually written.
Candidates are counted by votes and shape, a table of a few thousand cells at most however large the input; expectation-
maximisation over it estimates how reliable each labeler is, and its posteriors train the span classifier, a naive Bayes
model over votes and shape. Base spans always stay; other candidates stay if the classifier takes them and no base span
overlaps them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no input makes them backtrack over a long run twice.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before a pattern is tried on it.
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Looser patterns for further candidates.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[a-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
LOOSE_GUARD = {"email": r"(?i)[\[(]at[\])]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Cue words that come before such data, or before numbers of another sort.
CUES = {"email": r"\b(e-?mail|mail|contact|write)\b", "ip": r"\b(ip|address|server|host|client)\b", "card": r"\b(card|visa|credit|debit|payment)\b", "phone": r"\b(call|phone|tel|mobile|fax|cell)\b"}
OTHER = r"\b(version|isbn|issn|order|invoice|serial|build|release|sku)\b[^a-z]*$"
#: Gazetteers: frequent top-level domains, card issuers' first digits.
DOMAINS = r"(?i)(?:\.|dot[\])]\x20?)(com|org|net|edu|gov|info|io|co|us|uk|de|fr|es|it|nl|ch|at|be|eu|ca|au|jp|in|br|mx)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
#: How such data is usually written: a local part with a letter, numbers without leading zeros, 15 or 16 digits in one run or
#: in fours, an area code in brackets or between separators.
FORMS = {
    "email": r"(?i)^[^@\[( ]*[a-z]",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[0-9]{15,16}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}$",
}
VOTES = 5
_SPAN = "array<struct<kind:string,start:int,end:int,cell:string>>"
_FOUND = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, the match, 40 characters before and one after it."""

    def placed(x: Column) -> Column:
        n = F.size(x.found)
        rows = F.arrays_zip(F.slice(x.parts, 1, n).alias("p"), x.found.alias("f"), F.slice(x.parts, 2, n).alias("q"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

        def step(acc: Column, r: Column) -> Column:
            start = acc.at + F.length(r.p)
            end = start + F.length(r.f)
            one = F.struct(start.alias("start"), end.alias("end"), r.f.alias("text"), F.lower(F.right(r.p, F.lit(40))).alias("before"), F.left(r.q, F.lit(1)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc.out, F.array(one)).alias("out"))

        return F.when(n > 0, F.aggregate(rows, begin, step, lambda acc: acc.out)).otherwise(F.array().cast(_FOUND))

    return let(F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """The base checks of a match."""
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(x), lambda d: F.length(d).between(14, 19) & F.when(F.length(d) <= 19, _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0")) if no is not None else F.when(yes, F.lit("+")).otherwise(F.lit("-"))


def _cell(kind: str, m: Column, base: bool, valid: Column) -> Column:
    """A candidate's votes and shape as text: pattern, gazetteer, cue, border and form vote, length class, share of digits."""
    checks = _vote(valid) if base else F.lit("0")
    if kind == "email":
        listed = _vote(m.text.rlike(DOMAINS))
    elif kind == "ip":
        listed = _vote(~m.text.rlike(r"^(0+|127|2[4-9][0-9]|22[4-9]|23[0-9])\.") & valid)
    elif kind == "card":
        listed = _vote(_digits(m.text).rlike(ISSUERS))
    else:
        listed = let(_digits(m.text), lambda d: _vote(d.rlike("^1?[2-9][0-9]{2}[2-9]") | m.text.startswith("+") & ~m.text.startswith("+1"), d.rlike("^1?[01]")))
    cue = _vote(m.before.rlike(CUES[kind]), m.before.rlike(OTHER))
    border = _vote(~m.before.rlike(r"[\p{L}0-9_]$") & ~m.after.rlike(r"[\p{L}0-9_]"))
    form = _vote(m.text.rlike(FORMS[kind]))
    size = F.least(F.floor((m.end - m.start) / 8), F.lit(4)).cast("string")
    share = F.floor(3.99 * F.length(_digits(m.text)) / F.length(m.text)).cast("string")
    return F.concat(F.lit(kind[0]), checks, listed, cue, border, form, size, share)


def _span_of(kind: str, strict: bool) -> Callable[[Column], Column]:
    def span(m: Column) -> Column:
        ok = _valid(kind, m.text) if strict else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), m.start.alias("start"), m.end.alias("end"), let(ok, lambda v: _cell(kind, m, strict, v)).alias("cell"))

    return span


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans of a text (null: empty) and its other candidates, as arrays of (kind, start, end, cell)."""
    text = F.coalesce(text, F.lit(""))
    base, other = [], []
    none = F.array().cast(_SPAN)
    for kind in KINDS:
        for strict, pattern, guard in ((True, BASE.get(kind), GUARD.get(kind)), (False, LOOSE.get(kind), LOOSE_GUARD.get(kind))):
            if pattern is None:
                continue

            may = F.contains(text, F.lit("@")) if guard == "@" else text.rlike(guard)
            (base if strict else other).append(F.when(may, F.transform(_matches(text, pattern), _span_of(kind, strict))).otherwise(none))
    return F.flatten(F.array(*base)), F.flatten(F.array(*other))


def _spans(docs: DataFrame) -> DataFrame:
    """docs with columns _base and _other; a strict pattern's match that fails its checks is a candidate of the other sort."""
    base, other = candidates(F.col("text"))
    found = docs.withColumns({"_strict": base, "_loose": other})
    good = lambda x: F.substring(x.cell, 2, 1) == "+"
    return found.withColumns({"_base": F.filter("_strict", good), "_other": F.concat(F.filter("_strict", lambda x: ~good(x)), F.col("_loose"))}).drop("_strict", "_loose")


def estimate(cells: dict[str, int], rounds: int = 30) -> dict[str, float]:
    """The posterior of each cell that a span is personal data, by expectation-maximisation over its votes.

    For each kind two classes with a share of their own; each labeler votes +, 0 or - with probabilities that depend on
    the class alone. It starts from the balance of the votes."""
    post = {c: 1 / (1 + math.exp(-1.5 * sum({"+": 1, "-": -1}.get(v, 0) for v in c[1 : VOTES + 1]))) for c in cells}
    for _ in range(rounds):
        mass: dict[tuple, float] = defaultdict(lambda: 0.5)
        for c, n in cells.items():
            for y, p in ((1, post[c]), (0, 1 - post[c])):
                mass[c[0], y] += n * p
                for i in range(1, VOTES + 1):
                    mass[c[0], y, i, c[i]] += n * p
        for c in cells:
            odds = math.log(mass[c[0], 1] / mass[c[0], 0])
            for i in range(1, VOTES + 1):
                odds += math.log(mass[c[0], 1, i, c[i]] / (mass[c[0], 1] + 1.5)) - math.log(mass[c[0], 0, i, c[i]] / (mass[c[0], 0] + 1.5))
            post[c] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post


def classifier(cells: dict[str, int]) -> Callable[[str], float]:
    """The span classifier: naive Bayes over kind, votes and shape, trained on the posteriors."""
    post = estimate(cells)
    mass: dict[tuple, float] = defaultdict(lambda: 0.5)
    for c, n in cells.items():
        for y, p in ((1, post[c]), (0, 1 - post[c])):
            mass[y] += n * p
            for i, v in enumerate(c):
                mass[y, i, v] += n * p

    def score(c: str) -> float:
        odds = math.log(mass[1] / mass[0]) + sum(math.log(mass[1, i, v] / (mass[1] + 2)) - math.log(mass[0, i, v] / (mass[0] + 2)) for i, v in enumerate(c))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))

    return score


#: What it takes to outweigh a failed check: a cue word before the candidate, and this posterior instead of a half.
OUTWEIGHS = 0.98


def takes(cell: str, score: float, least: float = 0.5) -> bool:
    checks, cue = cell[1], cell[3]
    return score >= least if checks != "-" else cue == "+" and score >= max(least, OUTWEIGHS)


def fit(docs: DataFrame, least: float = 0.5) -> list[str]:
    """The cells that the classifier takes, from all candidates of docs (text). One whose checks failed takes more than a half."""
    found = _spans(docs.select("text")).select(F.explode(F.concat("_base", "_other")).alias("x"))
    cells = {r[0]: r[1] for r in found.groupBy("x.cell").agg(F.count("*")).collect()}  # a few thousand at most
    if not cells:
        return []
    score = classifier(cells)
    return sorted(c for c in cells if takes(c, score(c), least))


def annotate(docs: DataFrame, taken: list[str]) -> DataFrame:
    """docs with columns base and spans (replaced if there): arrays of (kind, start, end) in code points, end exclusive, by
    start, then kind in the order of KINDS.

    A null or empty text has no spans. Repeated rows stay; other columns pass through."""
    found = _spans(docs.drop("base", "spans"))
    accepted = F.array(*map(F.lit, taken)).cast("array<string>")
    more = F.filter("_other", lambda x: F.array_contains(accepted, x.cell) & ~F.exists("_base", lambda b: (b.start < x.end) & (x.start < b.end)))
    rank = F.create_map(*(y for i, k in enumerate(KINDS) for y in (F.lit(k), F.lit(i))))
    ordered = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), rank[x.kind].alias("rank"), x.end.alias("end"), x.kind.alias("kind")))), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end")))
    return found.withColumns({"base": ordered(F.col("_base")), "spans": ordered(F.concat(F.col("_base"), more))}).drop("_base", "_other")


def masked(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by its kind in brackets; a null text stays null."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc.at + 1, x.start - acc.at)
        return F.when(x.start < acc.at, F.struct(acc.out.alias("out"), F.greatest(acc.at, x.end).alias("at"))).otherwise(F.struct(F.concat(acc.out, gap, F.lit("["), F.upper(x.kind), F.lit("]")).alias("out"), x.end.alias("at")))

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))).otherwise(text)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def op7_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = annotate(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
