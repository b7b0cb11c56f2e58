"""Language ID by word-first backoff.

Known words score by their log frequency in each language; a word that the model doesn't know falls back to its character
n-grams, from the longest order that has any known one down to single characters. A text's score is the posterior of its
best language under equal priors.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ORDERS = (5, 4, 3, 2, 1)
SAMPLE_DOCS = 1500  # labelled documents of each language that the model is fitted on, about; all of a language that has fewer
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    found = _WORD.findall(text.lower())
    if found and not found[0][0].isalpha():  # numerals that aren't digits, such as fractions
        found = [w for w in found if any(map(str.isalpha, w))]
    return found


@dataclass
class Model:
    """Log frequencies by language of known words and of n-grams (by order), one row of `table` each."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        padded = f"^{word}$"
        for n in ORDERS:
            rows = [r for i in range(len(padded) - n + 1) if (r := self.grams.get(padded[i : i + n])) is not None]
            if rows:
                return self.table[rows].mean(0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Predicts with a model; keeps the rows of unseen words that it has met, up to a bound."""

    def __init__(self, model: Model, kept: int = 300_000):
        self.model, self.kept = model, kept
        self._begin()

    def _begin(self) -> None:
        m = self.model
        self.rows, self.used = dict(m.words), len(m.table)
        self.table = np.concatenate([m.table, np.zeros((self.kept, len(m.langs)), np.float32)])

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        rows = self.rows
        for w in {w for w in words if w not in rows}:
            if self.used == len(self.table):
                break
            self.table[self.used] = self.model.unseen(w)
            rows[w] = self.used
            self.used += 1
        try:
            total = self.table[np.array([rows[w] for w in words])].sum(0, dtype=np.float64)
        except KeyError:  # the bound is reached: a text with more unseen words than that is summed word by word
            total = sum((self.table[rows[w]] if w in rows else self.model.unseen(w)).astype(np.float64) for w in words)
            self._begin()
        best = int(total.argmax())
        return self.model.langs[best], 1.0 / float(np.exp(np.clip(total - total[best], -700, 0)).sum())


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], int] = defaultdict(int)
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in words_of(text):
                seen[lang, w] += 1
    if seen:
        langs, words = zip(*seen, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least: int = 2) -> Model:
    """A model from docs (doc_id, text, lang): rows with a null text or lang teach nothing.

    sample_docs bounds the documents of each language it learns from: of a language with more, each is taken with the same
    probability by its id's hash; of one with fewer, all.
    A word is known if it occurs `least` times there; n-grams come from all words, known or not."""
    labelled = docs.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(sample_docs) / F.count("*")).alias("_share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(1 << 40)
    part = labelled.join(F.broadcast(sizes), "lang").where(place < F.col("_share"))
    counted = part.select("lang", "text").mapInArrow(_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted.column(0).to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    words: dict[str, list[int]] = defaultdict(lambda: [0] * len(langs))
    for lang, word, n in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        words[word][at[lang]] += n
    grams: list[dict[str, list[int]]] = [defaultdict(lambda: [0] * len(langs)) for _ in ORDERS]
    for word, n in words.items():
        padded = f"^{word}$"
        for j, order in enumerate(ORDERS):
            for i in range(len(padded) - order + 1):
                row = grams[j][padded[i : i + order]]
                for k, x in enumerate(n):
                    if x:
                        row[k] += x
    known = {w: n for w, n in words.items() if sum(n) >= least}
    tables, index, count = [], [], 0
    for part_ in (known, *({g: n for g, n in x.items() if sum(n) >= least} for x in grams)):
        a = np.array(list(part_.values()), np.float64).reshape(len(part_), len(langs))
        totals = np.array(list((words if part_ is known else part_).values()), np.float64).reshape(-1, len(langs)).sum(0) if part_ else np.ones(len(langs))
        tables.append(np.log((a + 0.5) / (totals + 0.5 * len(part_) + 1)).astype(np.float32))
        index.append(dict(zip(part_, range(count, count + len(part_)), strict=True)))
        count += len(part_)
    merged = {g: r for x in index[1:] for g, r in x.items()}
    return Model(langs, index[0], merged, np.concatenate(tables) if langs else np.zeros((0, 0), np.float32))


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            got = [scorer.predict(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to docs (text and any other columns but these two, which are replaced).

    `und` with score 0 for a null text, one without letters, or if the model has learned from nothing. Ties go to the
    language that sorts first."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    schema = docs.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return docs.mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double")


def op4_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~out))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


