"""Fuzzy line deduplication by MinHash, by DataFrame functions only.

A line's signature is the bottom of its hashed shingles. A shingle of the first kind is a word with the four characters that
follow its space; lines of fewer than BOTH such shingles, or with long words, have a second signature of shingles of five
characters, and lines of fewer than LEAST only that one. Any three of a signature's five smallest hashes make a band, ten in
all, so lines that share three of the five meet. Lines that meet are compared by the smallest hashes of their
shingles of five characters, and those that these leave likely by their exact Jaccard similarity over all.

First each line of a band meets the band's lead. Then all pairs of a band of at most SMALL lines meet that aren't connected. Lines
of larger bands that are open have finer keys: all hashes of their sets that fall into one of many segments, a few each, so that
lines which share only a passage seldom have one in common. Of these groups, too, each line meets the lead first, and then every
pair that is still open meets: no group is cut, and no pair of a group is left undecided. Sizes of sets are compared within the
joins. Union-find over the links that hold leaves one line of each component, the first by document and place.

`bottoms` and `shingles` are plain numpy versions of signatures and sets, for comparison.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keep, let, release, scratch
from .files import forget
from .graph import components

SHARE = 80  # hundredths of Jaccard similarity
WIDTH = 5  # characters of a shingle
LEAST, BOTH, WORD = 8, 16, 16  # distinct shingles of words: from here on they make a signature, up to here characters do as well, as if words are longer
BOTTOM, SHARED = 5, 3
LOW = 24  # hashes of a long line that are looked at for its smallest ones, about
SMALL = 16  # lines of a band of which all pairs meet; those of larger ones by finer keys
FINE, KEYS, MOST_KEYS = 10, 96, 128  # hashes of a segment at least, on average, and how many segments make keys
SOLID = 3  # hashes that a segment has at least to be a key, unless it is the whole set
SKETCH, ALIKE = 32, 20  # smallest hashes of a line's set, and how many two lines have in common at least: 26 on average at a similarity of 0.8
OF = 100
AT_ONCE = 200_000  # characters whose shingles are hashed at once
_M = np.uint64(0x9E3779B97F4A7C15)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(line))


def _powers() -> list[np.uint64]:
    out = [_M]
    for _ in range(3):
        out.append(out[-1] * out[-1])
    return out


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k code points, k being 5 or 9."""
    with np.errstate(over="ignore"):
        m1, m2, m4, _ = _powers()
        h = codes[:-1] * m1 + codes[1:]
        h = h[:-2] * m2 + h[2:]
        if k == 9:
            h = h[:-4] * m4 + h[4:]
        h = h[:-1] * m1 + codes[k - 1 :]
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def shingles(line: str) -> np.ndarray:
    """The sorted distinct hashes of a line's shingles of five characters; a shorter line is its own."""
    if len(line) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))], np.uint64)
    return np.unique(windows(codes_of(line), WIDTH))


def _lowest(h: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n lines its BOTTOM smallest distinct hashes in order, and how many there are."""
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])]) if len(h) else np.zeros(0, bool)
    h, line = h[fresh], line[fresh]
    counts = np.bincount(line, minlength=n)
    rank = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros((n, BOTTOM), np.uint64)
    low = rank < BOTTOM
    out[line[low], rank[low]] = h[low]
    return out, counts


def bottoms(lines: list[str], k: int, most: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of lines by shingles of k characters: hashes (a row for each line) and which of them are there. Lines of
    `most` characters in all, or one longer line, are looked at together."""
    parts, begin, held = [], 0, 0
    for i, x in enumerate(lines):
        held += len(x)
        if held >= most or i == len(lines) - 1:
            parts.append(_bottoms(lines[begin : i + 1], k))
            begin, held = i + 1, 0
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _bottoms(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    n, lengths = len(lines), np.array([len(x) for x in lines], np.int64)
    counts = np.maximum(0, lengths - k + 1)
    none = np.zeros((n, BOTTOM), np.uint64), np.zeros((n, BOTTOM), bool)
    if not counts.sum():
        return none
    starts, before = np.cumsum(lengths) - lengths, np.cumsum(counts) - counts
    h = windows(codes_of("".join(lines)), k)[np.arange(counts.sum()) + np.repeat(starts - before, counts)]
    line = np.repeat(np.arange(n), counts)
    limit = np.where(counts > 4 * LOW, (2.0**64 * LOW / np.maximum(counts, 1)).clip(0, 2.0**63).astype(np.uint64), np.uint64(2**64 - 1))
    low = h <= np.repeat(limit, counts)
    out, got = _lowest(h[low], line[low], n)
    again = (got < BOTTOM) & (counts > 4 * LOW)  # repetitive lines: few distinct shingles, none of them low
    if again.any():
        whole = again[line]
        full, more = _lowest(h[whole], line[whole], n)
        out[again], got[again] = full[again], more[again]
    return out, np.arange(BOTTOM)[None, :] < got[:, None]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, key, line) of every line that isn't blank; repeated rows give repeated rows."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("parts"))  # hashed once, not for each line
    found = parts.select("doc_id", "text_key", F.posexplode("parts").alias("pos", "line")).where(F.trim("line") != "")
    return found.select("doc_id", "text_key", "pos", normalised(F.col("line")).alias("line")).withColumn("key", F.xxhash64("line"))


def _pieces(line: Column) -> Column:
    """Hashes of all shingles of WIDTH code points."""
    return F.transform(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{WIDTH}}}))."), F.lit(1)), lambda p: F.xxhash64(p))


def _words(line: Column) -> Column:
    """Distinct hashes of each word with what follows."""
    return F.array_distinct(let(F.split(line, " "), lambda w: F.zip_with(w, F.slice(w, 2, 1 << 30), lambda x, y: F.xxhash64(x, F.substring(y, 1, 4)))))


def _bands(low: Column, kind: int, shared: int = SHARED) -> list[Column]:
    """Any `shared` of a signature's hashes; of one that has fewer, all."""
    some = [F.when(F.size(low) > max(x), F.xxhash64(F.lit(kind), *(F.get(low, i) for i in x))) for x in combinations(range(BOTTOM), shared)]
    return [*some, F.when(F.size(low).between(1, shared - 1), F.xxhash64(F.lit(kind), low))]


def _described(texts: DataFrame) -> DataFrame:
    """texts (key, line) with the size n of a line's set and its smallest hashes in order, low."""
    sets = texts.select("key", "line", F.array_distinct(_pieces(F.col("line"))).alias("s"))
    return sets.select("key", "line", F.size("s").alias("n"), F.slice(F.sort_array("s"), 1, SKETCH).alias("low"))


def _alike_sizes(x: Column, y: Column, share: int) -> Column:
    """Whether sets of x and y elements can have a similarity of share hundredths."""
    return OF * F.least(x, y) >= share * F.greatest(x, y)


def _likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of keys whose smallest hashes allow a similarity."""
    x, y = (texts.select(F.col("key").alias(k), F.col("low").alias(f"{k}_low")) for k in "ab")
    both = F.size(F.array_intersect("a_low", "b_low"))
    return pairs.join(x, "a").join(y, "b").where(SKETCH * both >= ALIKE * F.least(F.size("a_low"), F.size("b_low"))).select("a", "b")


def _similar(pairs: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """Those pairs (a, b) of keys whose lines have a Jaccard similarity of share hundredths or more, by their whole sets."""
    x, y = (texts.select(F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("line").alias(f"{k}_line")) for k in "ab")
    common = F.size(F.array_intersect(_pieces(F.col("a_line")), _pieces(F.col("b_line"))))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), common.alias("both"))
    return both.where((F.col("both") > 0) & (OF * F.col("both") >= share * (F.col("n") - F.col("both")))).select("a", "b")


def _led(members: DataFrame, share: int) -> DataFrame:
    """Distinct pairs (a, b) of each group's lead, the line with most links, and its others, of those that aren't connected:
    (band, key, n, met, links)."""
    leads = members.groupBy("band").agg(F.min(F.struct((-F.col("links")).alias("most"), "key", "n", "met")).alias("_lead"), F.min("met").alias("_x"), F.max("met").alias("_y")).where("_x <> _y").select("band", "_lead")
    leads = few(keep(leads, "leads"), F.lit(48))
    apart = (F.col("met") != F.col("_lead.met")) & _alike_sizes(F.col("n"), F.col("_lead.n"), share)
    return members.join(leads, "band").where(apart).select(F.col("_lead.key").alias("a"), F.col("key").alias("b")).distinct()


def _open(members: DataFrame) -> DataFrame:
    """The members (band, key, n, met) of groups that aren't connected as a whole; of groups with the same members, of one."""
    sums = members.groupBy("band").agg(F.min("met").alias("x"), F.max("met").alias("y"), F.bit_xor(F.xxhash64("key")).alias("sum"), F.count("*").alias("of"))
    one = sums.where("x <> y").groupBy("sum", "of").agg(F.min("band").alias("band")).select("band", "of")
    return members.join(few(keep(one, "open"), F.lit(24)), "band")


def _all(members: DataFrame, share: int) -> DataFrame:
    """Distinct pairs (a, b) of all lines of a group that aren't connected."""
    x, y = (members.select("band", F.col("key").alias(k), F.col("n").alias(f"{k}_n"), F.col("met").alias(f"{k}_met")) for k in "ab")
    apart = (F.col("a") < F.col("b")) & (F.col("a_met") != F.col("b_met")) & _alike_sizes(F.col("a_n"), F.col("b_n"), share)
    return x.join(y, "band").where(apart).select("a", "b").distinct()


def _pairs(members: DataFrame, share: int, led: bool) -> DataFrame:
    """The pairs of groups (band, key, n, met, links) that meet: with the groups' leads, or all that are open."""
    return _led(members, share) if led else _all(members, share)


def _fine(texts: DataFrame, share: int) -> DataFrame:
    """(band, key, n) of the finer keys of texts (key, line, n).

    A set's hashes fall into 2^level segments, so that each has FINE to 2 * FINE on average; as similar lines may lie on both sides
    of a step, a line has the levels of all sizes that a larger similar one can have. Few segments are dealt more than once."""
    level = lambda n: F.floor(F.log2(F.greatest(F.lit(1.0), n / F.lit(FINE)))).cast("int")
    levels = F.sequence(level(F.col("n")), level(F.col("n") * F.lit(OF / share)))
    rows = texts.select("key", "n", F.array_distinct(_pieces(F.col("line"))).alias("s"), F.explode(levels).alias("level"))
    times = F.when(F.col("level") == 0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(KEYS) / F.pow(F.lit(2), F.col("level"))).cast("int")))
    rows = rows.select("key", "n", "s", "level", F.explode(F.sequence(F.lit(1), times)).alias("deal"))
    rows = rows.select("key", "n", "level", "deal", F.explode("s").alias("h"))
    rows = rows.withColumn("segment", F.pmod(F.xxhash64("h", "deal"), F.pow(F.lit(2), F.col("level")).cast("long"))).where(F.col("segment") < MOST_KEYS)
    found = rows.groupBy("key", "n", "level", "deal", "segment").agg(F.bit_xor("h").alias("sum"), F.count("*").alias("of")).where((F.col("of") >= SOLID) | (F.col("level") == 0))
    return found.select(F.xxhash64("level", "deal", "segment", "sum", "of").alias("band"), "key", "n")


def _shared(bands: DataFrame) -> DataFrame:
    """The distinct rows of bands that more than one key has."""
    more = bands.groupBy("band").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("band")
    return bands.join(few(keep(more, "bands"), F.lit(16)), "band", "left_semi").distinct()


def line_links(docs: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The lines' places (key, doc_id, text_key, pos) in docs, and the components (node, root) of similar ones."""
    spark, lines = docs.sparkSession, _lines(docs)
    signed = lines.withColumn("v", _words(F.col("line"))).withColumn("d", F.size("v"))
    first = F.when(F.col("d") >= LEAST, F.slice(F.sort_array("v"), 1, BOTTOM))
    second = F.when((F.col("d") < BOTH) | (F.length("line") > WORD * F.col("d")), F.slice(F.sort_array(F.array_distinct(_pieces(F.col("line")))), 1, BOTTOM))
    signed = keep(signed.select("key", "doc_id", "text_key", "pos", first.alias("w"), second.alias("c")), "signatures", fat := scratch(spark, "signatures"))
    bands = signed.select("key", F.explode(F.array_compact(F.array(*_bands(F.col("w"), 1), *_bands(F.col("c"), 2)))).alias("band"))
    bands = keep(_shared(bands), "members")
    places = keep(signed.select("key", "doc_id", "text_key", "pos"), "places")
    forget(fat)
    release(spark)
    wanted = keep(bands.select("key").distinct(), "wanted")
    texts = lines.join(few(wanted, F.lit(16)), "key", "left_semi").groupBy("key").agg(F.min("line").alias("line"))
    texts = keep(_described(texts).where("n > 0"), "band-lines", at := scratch(spark, "band-lines"))
    sizes = few(texts.select("key", "n"), F.lit(20))
    bands = keep(bands.join(sizes, "key"), "members")
    seen = links = roots = None

    def met(members: DataFrame) -> DataFrame:
        """The members with their component and their number of links so far."""
        if links is None:
            return members.select("*", F.col("key").alias("met"), F.lit(0).cast("long").alias("links"))
        ends = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("_links"))
        known = keep(ends.join(roots.toDF("key", "_met"), "key", "left"), "known")
        found = members.join(few(known, F.lit(32)), "key", "left")
        return found.select("band", "key", "n", F.coalesce("_met", "key").alias("met"), F.coalesce("_links", F.lit(0).cast("long")).alias("links"))

    def decide(pairs: DataFrame) -> None:
        nonlocal seen, links, roots
        new = keep(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        likely = keep(_likely(new, texts), "likely")
        found = keep(_similar(likely, texts, share), "links")
        seen, links = (new, found) if seen is None else (seen.unionByName(new), links.unionByName(found))
        roots = keep(components(links), "roots")
        release(spark)

    decide(_pairs(met(bands), share, True))
    rest = keep(_open(met(bands)), "rest")
    hot = keep(rest.where(F.col("of") > SMALL).select("key").distinct(), "hot")
    fine = keep(_fine(texts.join(few(hot, F.lit(16)), "key", "left_semi"), share), "fine", keys := scratch(spark, "fine"))
    fine = keep(_shared(fine), "fine")
    forget(keys)
    decide(_pairs(rest.where(F.col("of") <= SMALL), share, False).unionByName(_pairs(met(fine), share, True)).distinct())
    decide(_pairs(keep(_open(met(fine)), "rest"), share, False))
    forget(at)
    release(spark)
    return places, roots


def dedup_lines(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """docs with text cut to the lines that stay, and two more columns: n_lines and n_dropped (replaced if there).

    Lines are compared in lower case without spaces at their ends. Of lines that are equal or linked by similarity
    (Jaccard over character shingles of five, share hundredths or more) the first by doc_id, then place, stays, wherever it
    occurs; blank lines stay. Null text stays null with no lines. Repeated rows are one document: all copies keep its
    lines. A null doc_id sorts first. Other columns pass through."""
    docs = docs.drop("n_lines", "n_dropped")
    rows = docs.select("doc_id", "text").where("text is not null")
    places, roots = line_links(rows, share)
    # Only lines that occur more than once, or have similar ones, can go.
    again = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.col("key").alias("root"))
    alike = roots.toDF("key", "root").unionByName(roots.select(F.col("root").alias("key"), "root"))
    many = keep(alike.unionByName(again).groupBy("key").agg(F.min_by("root", F.col("root") == F.col("key")).alias("root")), "many")
    found = keep(places.join(few(many, F.lit(16)), "key").select("root", "doc_id", "text_key", "pos"), "found")
    best = keep(found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("best")), "best")
    dropped = found.join(few(best, F.lit(40)), "root").where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("best")))
    per_doc = keep(dropped.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "dropped")
    gone = per_doc.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "gone")
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    joined = keyed.join(few(gone, 32 + 4 * F.size("gone")), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")

    def rest(parts: Column) -> Column:
        """The stretches between dropped lines, so that a text with many of both is still one pass."""
        cuts = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(parts)))
        ends = F.arrays_zip(F.slice(cuts, 1, F.size("gone") + 1).alias("a"), F.slice(cuts, 2, F.size("gone") + 1).alias("b"))
        return F.array_join(F.flatten(F.transform(ends, lambda x: F.slice(parts, x.a + 2, x.b - x.a - 1))), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    order = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns]
    return joined.select(*order, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op3_line_dedup(spark, sf_dir):
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", "text")
