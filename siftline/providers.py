"""What comes from models: interfaces, and deterministic stand-ins that need no network.

A provider turns columns into a column, so it runs wherever the rows are; one that calls a service would do so in a pandas UDF.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import text as X


class Embedding(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, document: Column) -> Column: ...


class Llm(Protocol):
    def answer(self, query: Column, evidence: Column, first: Column) -> Column: ...

    def variations(self, query: Column) -> Column: ...

    def sub_queries(self, query: Column) -> Column: ...

    def passage(self, query: Column) -> Column: ...

    def supported(self, sentence: Column, evidence: Column) -> Column: ...


def _unit_counts(dimensions: int):
    @F.pandas_udf("array<double>")
    def counted(places: pd.Series) -> pd.Series:
        out = []
        for p in places:
            n = np.bincount(p, minlength=dimensions).astype(np.float64) if p is not None and len(p) else np.zeros(dimensions)
            norm = np.sqrt((n * n).sum())
            out.append(n / norm if norm > 0 else n)
        return pd.Series(out)

    return counted.asNondeterministic()  # so that no optimizer rule computes it twice, or for rows that a join drops


@dataclass
class HashedWords:
    """Embeds a text by the hashes of its words: counts over `dimensions`, at length 1; a text without words is all zeros."""

    dimensions: int = 64

    def embed(self, text: Column) -> Column:
        places = F.transform(X.tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(self.dimensions)).cast("int"))
        return _unit_counts(self.dimensions)(places)


@dataclass
class SharedWords:
    """Scores a document by the share of the query's words that it has."""

    def score(self, query: Column, document: Column) -> Column:
        return X.lexical_overlap(X.query_tokens(query), F.array_distinct(X.tokens(F.coalesce(document, F.lit("")))))


@dataclass
class Extract:
    """Answers with the first sentence of the first chunk; varies a query by leaving out its last or first word; takes it apart
    at `and`; a sentence is supported if its words are in the evidence."""

    most: int = 400
    share: float = 0.5
    reranker: SharedWords = field(default_factory=SharedWords)

    def answer(self, query: Column, evidence: Column, first: Column) -> Column:
        one = F.get(F.split(F.left(F.coalesce(first, F.lit("")), F.lit(self.most)), r"(?<=[.!?])\s+"), 0)
        return F.when(F.trim(one) == "", F.lit("INSUFFICIENT_EVIDENCE")).otherwise(F.concat(F.trim(one), F.lit(" [1]")))

    def _words(self, query: Column) -> Column:
        return F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")

    def variations(self, query: Column) -> Column:
        w = self._words(query)
        cut = F.array(F.array_join(F.slice(w, 1, F.size(w) - 1), " "), F.array_join(F.slice(w, 2, F.size(w) - 1), " "))
        return F.to_json(F.when(F.size(w) > 1, cut).otherwise(F.array().cast("array<string>")))

    def sub_queries(self, query: Column) -> Column:
        return F.to_json(F.split(query, r"(?i)\s+(?:and|und|et|y|e)\s+"))

    def passage(self, query: Column) -> Column:
        return F.concat(F.lit("This passage explains "), query)

    def supported(self, sentence: Column, evidence: Column) -> Column:
        return self.reranker.score(F.regexp_replace(sentence, r"\[[\d\s,]+\]", ""), evidence) >= self.share


@dataclass
class Providers:
    embedding: Embedding = field(default_factory=HashedWords)
    reranker: Reranker | None = field(default_factory=SharedWords)
    llm: Llm = field(default_factory=Extract)
