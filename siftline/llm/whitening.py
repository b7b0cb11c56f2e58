"""Whitening of embeddings by an exact integer scatter matrix.

Entries become integers (floor of 256 times the entry), and each distinct vector counts once. From every vector one shift is
subtracted; sums and cross-products add up without rounding, as integers of any size: in a task by matrix products of limbs
that doubles hold exactly, between tasks as limbs that Spark sums in longs. n XX' - SS' is formed in exact integers on the
driver (a matrix of the dimension, however many rows), and only then turned into doubles and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

SCALE, COMPONENTS = 256, 4
LIMB, ROWS = 16, 1 << 20  # bits of a limb; rows whose products of limbs a double holds exactly
SENT = 30  # bits of a limb between tasks: a long holds the sum of 2^33 of them
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    """vectors with x array<long> beside their columns: floor(256 * entry), at the limits of a long where it is beyond them. Rows
    whose embedding is null or has null or non-finite entries go."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).withColumn("x", F.transform(e, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(x: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """x as the sum of limbs[i] << (bits * i): all but the last one from 0 to 2^bits - 1, the last one of that size and signed."""
    out = []
    while (x < -(1 << (bits - 1))).any() or (x >= 1 << (bits - 1)).any():
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of int64 x, as arrays of Python integers."""
    d = x.shape[1]
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    exact = np.frompyfunc(int, 1, 1)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS])
        for i, a in enumerate(parts):
            total += exact(a.sum(0)) * (1 << (LIMB * i))
            for j, b in enumerate(parts):
                cross += exact(a.T @ b) * (1 << (LIMB * (i + j)))
    return total, cross


def _shifted(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift in int64; vectors so far from the shift that the difference doesn't fit raise."""
    out = x - shift
    if (((x ^ shift) & (x ^ out)) < 0).any():
        raise OverflowError("entries of embeddings are too far apart for 64-bit differences")
    return out


def _partial_sums(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, j, limb, value): the task's cross-products for j >= i, and its sums with j = -1, in limbs of SENT bits; (-1, -1) counts
    the rows."""
    n, d = 0, len(shift)
    total, cross = np.zeros(d, object), np.zeros((d, d), object)
    for b in batches:
        if b.num_rows:
            s, c = scatter(_shifted(_matrix(b.column(0)), shift))
            n, total, cross = n + b.num_rows, total + s, cross + c
    if not n:
        return
    rows = [(-1, -1, 0, n)]
    for i in range(d):
        for j, v in [(-1, total[i]), *((j, cross[i, j]) for j in range(i, d))]:
            k = 0
            while not -(1 << (SENT - 1)) <= v < 1 << (SENT - 1):
                rows.append((i, j, k, v & ((1 << SENT) - 1)))
                v >>= SENT
                k += 1
            rows.append((i, j, k, v))
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["i", "j", "limb", "value"])


class Whitening:
    """What is fitted: n, the sums S, the components' eigenvalues and unit eigenvectors (columns), and the trace of V."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace


def decomposed(n: int, shift: list[int], sums: np.ndarray, cross: np.ndarray, most: int = COMPONENTS) -> Whitening:
    """From exact sums and cross-products of shifted vectors. Components without variance (an eigenvalue no larger than the
    rounding of the trace) are left out."""
    d = len(shift)
    if not d:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    centred = n * cross - np.outer(sums, sums)  # n^2 V; the shift cancels
    v = np.array([[centred[i, j] / (n * n) for j in range(d)] for i in range(d)], np.float64)  # Python's division of integers rounds once
    trace = sum(centred[i, i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > trace * d * np.finfo(np.float64).eps).sum()) if trace > 0 else 0
    return Whitening(n, [int(s) + n * int(k) for s, k in zip(sums, shift, strict=True)], values[:kept].copy(), vectors[:, :kept].copy(), float(trace))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """distinct: x array<long>, each vector once, all of one length. None if there are none."""
    first = distinct.first()
    if first is None:
        return None
    shift = list(first.x)
    d = len(shift)
    partials = distinct.select("x").mapInArrow(partial(_partial_sums, shift=np.array(shift, np.int64)), "i long, j long, limb long, value long")
    n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in partials.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():  # dimension x dimension numbers
        v = int(r.value) << (SENT * r.limb)
        if r.i < 0:
            n = v
        elif r.j < 0:
            sums[r.i] += v
        else:
            cross[r.i, r.j] += v
            if r.j != r.i:
                cross[r.j, r.i] += v
    return decomposed(n, shift, sums, cross, components)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n in doubles, from exact n*x - S, and the sums of the squares of the latter (None beyond a long)."""
    reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    small = max(reach, x.shape[1] * reach * reach) <= LONG
    y = x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)
    square = (y * y).sum(1).tolist() if x.shape[1] else [0] * len(x)
    return (y / n).astype(np.float64), [s if s <= LONG else None for s in square]


def whitened(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, list[int | None]]:
    centred, square = _centred(x, w.n, w.sums)
    return centred @ w.vectors / np.sqrt(w.values), square


def _moments(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    """(i, j, value): the task's sums of products of whitened components, and their sums with j = -1."""
    k = len(w.values)
    total, cross = np.zeros(k), np.zeros((k, k))
    for b in batches:
        if b.num_rows:
            y = whitened(_matrix(b.column(0)), w)[0]
            total, cross = total + y.sum(0), cross + y.T @ y
    rows = [(i, j, float(cross[i, j])) for i in range(k) for j in range(k)] + [(i, -1, float(total[i])) for i in range(k)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["i", "j", "value"])


def identity_error(distinct: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, minus the identity."""
    k = len(w.values)
    if not k:
        return 0.0
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in distinct.select("x").mapInArrow(partial(_moments, w=w), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        if r.j < 0:
            mean[r.i] = r.value / w.n
        else:
            cov[r.i, r.j] = r.value / w.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max())


def _projected(batches: Iterator[pa.RecordBatch], w: Whitening, error: float) -> Iterator[pa.RecordBatch]:
    k = len(w.values)
    explained = w.values / w.trace if k else w.values
    for b in batches:
        if not b.num_rows or not k:
            continue
        y, square = whitened(_matrix(b.column(1)), w)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, w.n), pa.int64()), pa.array([s for s in square for _ in range(k)], pa.int64()), pa.array(y.ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each row of vectors (vec_id, embedding;
    other columns are ignored) and each component.

    Rows whose embedding is null or has null or non-finite entries go. If lengths differ, the one most distinct vectors have counts
    (of equally many the longer one), and the others go. Repeated rows and null ids stay; equal vectors count once in the fit.
    There are as many components as asked for, or fewer if fewer have variance: none of an empty table, of empty vectors or
    of a single distinct one, so the result is empty then. deviation is null where it is beyond a long."""
    x = keep(quantised(vectors.select(F.col("vec_id").cast("long"), "embedding")).select("vec_id", "x"), "whitening-x")
    distinct = keep(x.select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    distinct, x = distinct.where(F.size("x") == d), x.where(F.size("x") == d)
    w = fit(distinct, components) or Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    error = identity_error(distinct, w)
    return x.mapInArrow(partial(_projected, w=w, error=error), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
