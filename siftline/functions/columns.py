"""Helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Bytes of rows that may be sent to every task, summed up before; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def few(df: DataFrame, width: Column) -> DataFrame:
    """df, to be sent to every task if its rows of `width` bytes are within the bound."""
    total = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
