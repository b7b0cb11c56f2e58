"""All similar pairs within blocks of sets: a sparse matrix product that accumulates overlap counts over ranges of columns.

A block's rows are cut into parts of a bounded size. First each part, with the block's lead row in it, is multiplied by
itself; then rows that this didn't connect with their lead meet the other parts. So copies of one text cost no more than
their number, and rows go to several parts only if they are in a block without being connected to its lead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, keep
from .graph import components

OF, PART = 100, 256
WIDE, ENTRIES = 8, 2_000_000  # parts that meet the far rows together, if their sets have no more numbers than that, about
RANGE = 4096  # columns that are multiplied at once


def _needed(a: np.ndarray, b: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The overlap that a link of sets of these sizes takes, and which pairs of sizes allow one."""
    a, b = a[:, None], b[None, :]
    need = (-(-share * (a + b) // (OF + share))).astype(np.int32)
    return need, (np.minimum(a, b) * OF >= share * np.maximum(a, b)) & (a > 0)


def overlaps(rows: list[np.ndarray], others: list[np.ndarray] | None, apart: np.ndarray, share: int, totals: list[int] | None = None, width: int = RANGE) -> list[tuple[int, int]]:
    """Pairs (i, j) of a row and another one (of rows i < j, if there are no others) whose sets have a Jaccard similarity of
    share hundredths or more, where apart[i, j]; the product of the incidence matrices, accumulated over ranges of `width`
    columns. After each range, pairs that the columns to come can't lift to the bound are discarded, and rows without a
    possible pair leave the later ranges. With totals, the sizes of sets of which only some columns are here: the pairs that
    the columns elsewhere can still lift to the bound."""
    square = others is None
    n, sets = len(rows), rows if square else [*rows, *others]
    here_ = np.array([len(x) for x in sets], np.int64)
    sizes = here_ if totals is None else np.array(totals, np.int64)
    if square and n == 2:  # most blocks: the product is one number
        (a, b), (x, y) = rows, sizes.tolist()
        if not apart[0, 1] or min(x, y) * OF < share * max(x, y) or not x:
            return []
        both = len(np.intersect1d(a, b, assume_unique=True)) + min(x - len(a), y - len(b))
        return [(0, 1)] if both and both * OF >= share * (x + y - both) else []
    need, may = _needed(sizes if square else sizes[:n], sizes if square else sizes[n:], share)
    may &= apart
    if square:
        may = np.triu(may, 1)
    if not may.any():
        return []
    _, column, degree = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), here_)
    if square:
        useful = degree > 1
    else:
        first = np.bincount(column[: here_[:n].sum()], minlength=len(degree))
        useful = (first > 0) & (first < degree)
    kept = useful[column]
    order = np.argsort(column[kept], kind="stable")
    row, column = row[kept][order], column[kept][order]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    elsewhere = (sizes - here_).astype(np.int32)
    left = np.bincount(row, minlength=len(sets)).astype(np.int32) + elsewhere
    acc = np.zeros(may.shape, np.int32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        may &= acc + np.minimum(left[: len(may), None], (left if square else left[n:])[None, :]) >= need  # what the columns to come can still add
        above, beside = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        if not len(above):
            return []
        here = slice(*np.searchsorted(column, [at, at + width]))
        block = np.zeros((len(sets), int(min(width, column[-1] + 1 - at))), np.float32)
        block[row[here], column[here] - at] = 1
        acc[np.ix_(above, beside)] += (block[above] @ block[beside if square else beside + n].T).astype(np.int32)
        left -= np.bincount(row[here], minlength=len(sets)).astype(np.int32)
    if totals is not None:
        acc = acc + np.minimum(elsewhere[: len(may), None], (elsewhere if square else elsewhere[n:])[None, :])
    i, j = np.nonzero(may & (acc >= need))
    both, total = acc[i, j], sizes[i] + sizes[j if square else j + n]
    good = both * OF >= share * (total - both)
    return list(zip(i[good].tolist(), j[good].tolist(), strict=True))


def _stars(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each id that the links connect with a smaller one, with the smallest of these."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in links:
        if (r := top(x)) != (q := top(y)):
            up[max(r, q)] = min(r, q)
    return [(x, top(x)) for x in up]


def _multiplied(batches: Iterator[pa.RecordBatch], share: int, set_of: Callable, total_of: Callable | None) -> Iterator[pa.RecordBatch]:
    """Rows (block, i, j, far, part, met, id, payload) come sorted by task (block, i, j): pairs that connect what links
    among the rows do, or those between near and far ones if there are far ones, of different parts and not yet met."""
    at, rows = None, []
    found: list[tuple[int, int]] = []

    def close() -> None:
        if len(rows) < 2:
            return
        far, part, met, ids, payload = zip(*rows, strict=True)
        sets, n = [set_of(x) for x in payload], len(rows) - sum(far)  # far rows come last
        totals = [total_of(x) for x in payload] if total_of else None
        if n < len(rows):
            p, m = np.array(part), np.array(met, np.int64)
            apart = (p[:n, None] != p[None, n:]) & (m[:n, None] != m[None, n:])
            links = [(ids[i], ids[n + j]) for i, j in overlaps(sets[:n], sets[n:], apart, share, totals)] if n else []
        else:
            links = [(ids[i], ids[j]) for i, j in overlaps(sets, None, np.ones((n, n), bool), share, totals)]
        found.extend(_stars(links))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for b in batches:
        for block, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (block, i, j) != at:
                close()
                at, rows = (block, i, j), []
            rows.append(row)
        if len(found) > 10_000:
            yield out()
            found.clear()
    close()
    if found:
        yield out()


def shape(rows: Column, entries: Column, part: int, most: int) -> tuple[Column, Column]:
    """Of a block with so many rows and numbers in their sets: how many parts it is cut into, each of `part` rows and `most`
    numbers at most, and how many of them meet far rows together."""
    parts = F.greatest(F.ceil(rows / part), F.ceil(entries / most)).cast("int")
    wide = F.greatest(F.lit(1), F.least(F.lit(WIDE), F.floor(ENTRIES * parts / F.greatest(entries, F.lit(1))))).cast("int")
    return parts.alias("parts"), wide.alias("wide")


def block_links(rows: DataFrame, share: int, set_of: Callable, part: int = PART, total_of: Callable | None = None) -> DataFrame:
    """Pairs (a, b) that connect all similar rows of each block as links do; rows: (block, lead, parts, wide, id, payload), lead
    being the id of one of the block's rows, parts how many parts it is cut into, and wide how many parts meet far rows
    together (see shape). set_of makes a sorted array of distinct numbers of a payload. With total_of, a payload has only some
    of a set's numbers, total_of gives how many there are in all, and the pairs are those that may be similar."""
    layout = ["block", "i", "j", "far", "part", "met", "id", "payload"]

    def multiplied(work: DataFrame) -> DataFrame:
        dealt = work.select(layout).repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "far", "id")
        return dealt.mapInArrow(partial(_multiplied, share=share, set_of=set_of, total_of=total_of), "a long, b long")

    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    none = {"j": F.lit(0), "far": F.lit(0), "met": F.lit(0).cast("long")}
    leads = rows.where("id = lead and parts > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("i <> part")
    first = keep(multiplied(rows.withColumns({"i": F.col("part"), **none}).unionByName(leads.withColumns(none))).distinct(), "links")
    large = rows.where("parts > 1")
    if large.isEmpty():
        return first
    met = components(first)
    large = keep(large.join(met.toDF("id", "_met"), "id", "left").withColumn("met", F.coalesce("_met", "id")).drop("_met"), "met")
    main = large.where("id = lead").select("block", F.col("met").alias("main")).distinct()
    rest = large.join(few(keep(main, "main"), F.lit(24)), "block").where("met <> main").drop("main")
    chunks = few(keep(rest.groupBy("block").agg(F.ceil(F.count("*") / (part * F.max("wide"))).cast("int").alias("chunks")), "chunks"), F.lit(24))
    rest = rest.join(chunks, "block").withColumn("j", F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int") + 1)
    at = lambda p: F.floor(p / F.col("wide")).cast("int")
    far = rest.withColumn("i", F.explode(F.sequence(F.lit(0), at(F.col("parts") - 1)))).withColumn("far", F.lit(1))
    near = large.join(chunks, "block").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("chunks")))).withColumns({"i": at(F.col("part")), "far": F.lit(0)})
    return first.unionByName(keep(multiplied(near.select(layout).unionByName(far.select(layout))), "more-links"))
