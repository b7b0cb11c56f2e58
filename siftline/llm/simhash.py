"""Near-duplicates by SimHash fingerprints under the generalised pigeonhole principle.

Fingerprints of 64 bits link when few bits differ. The bits are cut into parts, correlated bits into the same one. If
thresholds of -1 and more are dealt to the m parts so that they add up to distance - m + 1, two fingerprints within the
distance agree on some part within that part's threshold. Every distinct fingerprint is indexed by the value of each part and
probes the values within the thresholds that a dynamic program deals to it by the estimated number of candidates: a part whose
value is common gets -1 (not probed), a rare one may get more. Any such deal finds all links, whatever the estimates.

The fingerprints that meet at a value of a part are verified there and leave as stars, one edge for each fingerprint that is
linked with a smaller one. Values that many fingerprints share are cut into parts; first each of these, with the value's
smallest fingerprint in it, is searched, then what isn't connected with that one meets the other parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _stars
from .common import few, keep, small_batches, utf8
from .graph import components

BITS, WORDS, DISTANCE, SEED = 64, 3, 3, 42
MOST_PARTS = 5  # of the bits
PIECE = 1 << 16  # shingles whose bits are counted at once
HEAVY = 4096  # values of a part that have more than one in HEAVY of all fingerprints are counted by name: fewer than HEAVY
ROW, COMPARED = 400.0, 1.0  # cost of a row sent and of two fingerprints compared
PART = 20_000  # rows of a value that one task searches together
SHORT = 64  # rows of a value that are compared pair by pair
_ONE = np.uint64(1)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Of a text's shingles, A-Z in lower case: bit b is set if it is in more than half of the hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        cuts = zip(starts[at:to].tolist(), ends[min(words, len(parts)) - 1 :][at:to].tolist(), strict=True)
        h = np.fromiter((xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in cuts), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def _ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, for each pair of bits."""
    both = np.zeros((BITS, BITS))
    for b in batches:
        x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both += x.T @ x
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel().astype(np.int64))], ["i", "j", "n"])


def grouped_bits(both: np.ndarray, total: int, m: int) -> list[list[int]]:
    """The bits in m parts of nearly even size, each grown from the bit that is most correlated with those left by the one that is
    most correlated with the part. both: how often two bits are set together among `total` fingerprints."""
    p = np.diag(both) / max(1, total)
    spread = np.sqrt(p * (1 - p))
    scale = np.outer(spread, spread)
    corr = np.abs(np.divide(both / max(1, total) - np.outer(p, p), scale, out=np.zeros_like(scale), where=scale > 1e-12))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = (BITS + k) // m
        part = [max(left, key=lambda b: (round(corr[b, left].sum(), 9), -b))]
        left.remove(part[0])
        while len(part) < size:
            part.append(max(left, key=lambda b: (round(corr[b, part].sum(), 9), -b)))
            left.remove(part[-1])
        parts.append(sorted(part))
    return parts


def ball(width: int, radius: int) -> int:
    """Values within a number of changed bits."""
    return sum(comb(width, r) for r in range(radius + 1))


def dealt(costs: np.ndarray, distance: int) -> np.ndarray:
    """The cheapest thresholds of each fingerprint: costs[f, i, e + 1] is what threshold e costs part i. A dynamic program over the
    parts and the sum dealt so far; thresholds are -1 at least and add up to distance - m + 1."""
    n, m, _ = costs.shape
    total = distance + 1  # thresholds plus one each, over all parts
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    back = np.zeros((m, n, total + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for s in range(total + 1):
            for e in range(min(s, costs.shape[2] - 1) + 1):
                c = best[:, s - e] + costs[:, i, e]
                better = c < new[:, s]
                new[better, s] = c[better]
                back[i, better, s] = e
        best = new
    out, s = np.empty((n, m), np.int8), np.full(n, total)
    for i in range(m - 1, -1, -1):
        out[:, i] = back[i, np.arange(n), s]
        s = s - out[:, i]
    return out - 1


def parts_for(total: int, distance: int = DISTANCE) -> int:
    """How many parts cost least for so many distinct fingerprints if no value is common."""

    def cost(m: int) -> float:
        costs = np.zeros((1, m, distance + 2))
        for i in range(m):
            width = (BITS + i) // m
            costs[0, i, 1:] = [_price(width, e, ball(width, e) * total / 2.0**width) for e in range(distance + 1)]
        return m * ROW + sum(costs[0, i, e + 1] for i, e in enumerate(dealt(costs, distance)[0]))

    return min(range(2, MOST_PARTS + 1), key=cost)


def _price(width: int, radius: int, candidates):
    return ROW * ball(width, radius) + COMPARED * candidates


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of a part side by side."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & _ONE) << np.uint64(k)
    return out


def _valued(batches: Iterator[pa.RecordBatch], parts: list[list[int]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(parts)), len(fp))), pa.array(np.concatenate([values(fp, x).view(np.int64) for x in parts]))], ["part", "value"])


def thresholds(fp: np.ndarray, parts: list[list[int]], heavy: list[tuple[np.ndarray, np.ndarray]], light: list[float], distance: int) -> np.ndarray:
    """Each fingerprint's thresholds. heavy: the common values of each part, sorted, with their counts; light: what any other
    value has on average."""
    costs = np.zeros((len(fp), len(parts), distance + 2))
    for i, bits in enumerate(parts):
        v, (names, counts) = values(fp, bits), heavy[i]

        def count(x: np.ndarray, names=names, counts=counts, mean=light[i]) -> np.ndarray:
            if not len(names):
                return np.full(len(x), mean)
            at = np.minimum(np.searchsorted(names, x), len(names) - 1)
            return np.where(names[at] == x, counts[at], mean)

        found = count(v)
        costs[:, i, 1] = _price(len(bits), 0, found)
        if distance > 0:
            found = found + sum(count(v ^ (_ONE << np.uint64(k))) for k in range(len(bits)))
        for e in range(1, distance + 1):
            costs[:, i, e + 1] = _price(len(bits), e, found + (ball(len(bits), e) - ball(len(bits), 1)) * light[i])
    return dealt(costs, distance)


def _rows(batches: Iterator[pa.RecordBatch], parts: list[list[int]], heavy: list, light: list[float], distance: int) -> Iterator[pa.RecordBatch]:
    """(part, value, role, fp): role 1 indexes, 2 probes, 3 does both."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            fp = whole.column(0).to_numpy()[at : at + 4096].view(np.uint64)
            t = thresholds(fp, parts, heavy, light, distance)
            out = []
            for i, bits in enumerate(parts):
                v = values(fp, bits)
                out.append((i, v, np.where(t[:, i] >= 0, 3, 1), fp))
                for e in range(1, int(t[:, i].max(initial=0)) + 1):
                    who = np.flatnonzero(t[:, i] >= e)
                    for flips in combinations(range(len(bits)), e):
                        mask = np.uint64(sum(1 << k for k in flips))
                        out.append((i, v[who] ^ mask, np.full(len(who), 2), fp[who]))
                    if sum(len(x[1]) for x in out) > 500_000:
                        yield _table(out)
                        out = []
            if out:
                yield _table(out)


def _table(out: list) -> pa.RecordBatch:
    part = np.concatenate([np.full(len(x[1]), x[0]) for x in out])
    v, role, fp = (np.concatenate([x[k] for x in out]) for k in (1, 2, 3))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(v.view(np.int64)), pa.array(role, pa.int64()), pa.array(fp.view(np.int64))], ["part", "value", "role", "fp"])


def _may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roles of which one probes and the other one indexes."""
    return (((a >> 1) & b) | (a & (b >> 1))) & 1 > 0


def stars(fp: np.ndarray, role: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The links among a value's fingerprints as (fingerprint, another one of its component). Each search leaves with all that it
    reached, so a dense group costs a few passes over its rows."""
    found, left = [], np.flatnonzero(role & 1)  # whoever indexes starts; those that only probe are reached
    other = np.flatnonzero(role == 2)
    while len(left) and (len(left) > 1 or len(other)):
        root, left = left[0], left[1:]
        queue = [root]
        while queue:
            x = queue.pop()
            for name, rest in (("left", left), ("other", other)):
                hit = np.bitwise_count(fp[rest] ^ fp[x]) <= distance
                hit &= _may(role[rest], role[x])
                if hit.any():
                    queue += rest[hit].tolist()
                    found += [(y, int(fp[root])) for y in fp[rest[hit]].tolist()]
                    if name == "left":
                        left = rest[~hit]
                    else:
                        other = rest[~hit]
    return found


def _verified(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, value, i, j, role, fp) come sorted by all but the last two: edges (a, b) of fingerprints that link."""
    held: list[np.ndarray] = []

    def search(rows: np.ndarray) -> pa.RecordBatch | None:
        key, role, fp = rows[:4], rows[4], rows[5].view(np.uint64)
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(fp)]]))
        own = np.repeat(np.arange(len(start)), size)
        short = size[own] <= SHORT
        pairs: list[tuple[int, int]] = []
        s_own, s_role, s_fp = own[short], role[short], fp[short]
        for d in range(1, SHORT):
            at = np.flatnonzero(s_own[d:] == s_own[:-d])
            if not len(at):
                break
            hit = at[(np.bitwise_count(s_fp[at] ^ s_fp[at + d]) <= distance) & _may(s_role[at], s_role[at + d])]
            pairs += zip(s_fp[hit].tolist(), s_fp[hit + d].tolist(), strict=True)
        for k in np.flatnonzero(size > SHORT):
            at = slice(start[k], start[k] + size[k])
            pairs += stars(fp[at], role[at], distance)
        if not pairs:
            return None
        x = np.array(_stars(pairs), np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if not rows.shape[1]:
            continue
        ends = int((rows[:4] == rows[:4, -1:]).all(0).argmax())  # where the last value's rows begin, which may go on
        if ends or (held and (held[0][:4, 0] != rows[:4, 0]).any()):
            if out := search(np.concatenate([*held, rows[:, :ends]], 1)):
                yield out
            held = []
        held.append(rows[:, ends:])
    if held and (out := search(np.concatenate(held, 1))):
        yield out


def _met(rows: DataFrame, distance: int, name: str) -> DataFrame:
    layout = ["part", "value", "i", "j", "role", "fp"]
    dealt_out = rows.select(*(F.col(c).cast("long") for c in layout)).repartition("part", "value", "i", "j").sortWithinPartitions("part", "value", "i", "j")
    return keep(dealt_out.mapInArrow(partial(_verified, distance=distance), "a long, b long").distinct(), name)


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE, most: int = PART, m: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (fp long, distinct) within `distance` bits of each other. most: rows of a part's
    value in a task. m: parts, else as many as cost least.

    Only the counts of pairs of bits and of values that more than one in HEAVY fingerprints have reach the driver."""
    total = prints.count()
    both = np.zeros((BITS, BITS))
    for r in prints.mapInArrow(_ones, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r.i, r.j] = r.n
    m = m or parts_for(total, distance)
    parts = grouped_bits(both, total, m)
    counts = prints.mapInArrow(partial(_valued, parts=parts), "part long, value long").groupBy("part", "value").agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") > max(1, total // HEAVY)).collect()
    heavy, light = [], []
    for i, bits in enumerate(parts):
        own = sorted((r.value, r.n) for r in common if r.part == i)
        heavy.append((np.array([x for x, _ in own], np.uint64), np.array([x for _, x in own], np.float64)))
        light.append((total - sum(x for _, x in own)) / 2.0 ** len(bits))
    rows = keep(prints.mapInArrow(partial(_rows, parts=parts, heavy=heavy, light=light, distance=distance), "part long, value long, role long, fp long"), "simhash-rows")
    # Values with a fingerprint that indexes and another row that probes; the size says how many parts they are cut into.
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.min(F.when(F.col("role") != 2, F.col("fp"))).alias("lead"), F.bool_or(F.col("role") >= 2).alias("probed"))
    sizes = sizes.where("n > 1 and lead is not null and probed").select("part", "value", "lead", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    sizes = keep(sizes, "simhash-values")
    hot = few(sizes.where("parts > 1"), F.lit(28))
    plain = rows.join(sizes.where("parts = 1").select("part", "value"), ["part", "value"], "left_semi").withColumns({"i": F.lit(0), "j": F.lit(0)})
    large = rows.join(hot, ["part", "value"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    leads = large.where("fp = lead").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at <> i").withColumn("i", F.col("at"))
    own = ["part", "value", "i", "j", "role", "fp"]
    first = _met(plain.select(own).unionByName(large.withColumn("j", F.lit(0)).select(own)).unionByName(leads.withColumn("j", F.lit(0)).select(own)), distance, "simhash-links")
    if sizes.where("parts > 1").isEmpty():
        return first
    root = components(first).toDF("fp", "root")
    large = keep(large.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-large")
    main = few(keep(large.where("fp = lead").select("part", "value", F.col("root").alias("main")).distinct(), "simhash-main"), F.lit(24))
    far = large.join(main, ["part", "value"]).where("root <> main")
    chunks = few(keep(far.groupBy("part", "value").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks")), "simhash-chunks"), F.lit(20))
    far = far.join(chunks, ["part", "value"]).withColumn("j", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int") + 1)
    # A row that isn't connected with the lead meets the rows of every part; rows that are go to every chunk of such rows.
    away = far.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at <> i").withColumn("i", F.col("at"))
    near = large.join(chunks, ["part", "value"]).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
    return first.unionByName(_met(near.select(own).unionByName(away.select(own)).distinct(), distance, "simhash-more-links"))


def simhash_components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, most: int = PART, m: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id that links reach) for each row of docs
    (doc_id, text; other columns are ignored).

    Texts with fewer words than a shingle are one shingle; null and empty texts and those without words have the fingerprint
    zero, which links like any other. Equal fingerprints are one, so repeated rows and copies of a text cost no comparison. Rows
    without a doc_id stay and have the smallest doc_id of their component, null if it has none. An empty table gives an
    empty result."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text"))
    prints = keep(docs.mapInArrow(partial(_fingerprinted, words=words), "doc_id long, fp long"), "simhash")
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    links = fingerprint_links(classes.select("fp"), distance, most, m)
    root = components(links).toDF("fp", "root")
    found = keep(classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").select("root", "component_id")
    found = few(keep(found.join(least, "root").select("fp", "component_id"), "simhash-found"), F.lit(24))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp", "left").select("doc_id", hexed.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
