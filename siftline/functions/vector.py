"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for empty, unequally long or zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), 1 - dot(a, b) / scale).otherwise(1.0)


def parse(text: Column) -> Column:
    """'[1,2]' as array<double>; what isn't a finite number is dropped; null without brackets."""
    inner = F.when(text.rlike(r"^\s*\[.*\]\s*$"), F.regexp_replace(text, r"[\[\]\s]", ""))
    return F.filter(F.transform(F.split(inner, ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def sound(a: Column) -> Column:
    """Neither null nor empty, and without null or non-finite entries."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
