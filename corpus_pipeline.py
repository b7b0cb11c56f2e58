"""A corpus pipeline of five stages, each of which works on all that its predecessor kept.

Every stage's result is written as Parquet to the shared folder and read again. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import langid, line_dedup, ngram_join, packing, pii
from siftline.llm.common import few, keep

NEAR_WORDS, NEAR_SHARE = 5, 80  # near-duplicates: words of a shingle, hundredths of Jaccard similarity
LEAST_SCORE = 0.5  # of the language; below, the document is rejected


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that a stage works on, and the whole row beside them, so that no other column's name can clash."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def _changed(done: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs, those in new replaced."""
    return done.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known with a posterior of LEAST_SCORE or more; fills in a missing lang.

    A null or empty text, or one without letters, has no language and goes; so do all if nothing is labelled. Repeated rows
    stay, ties go to the language that sorts first, an empty table stays empty."""
    done = langid.predict(_carried(docs, "text"), langid.fit(docs)).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _changed(done, docs, lang=F.coalesce(F.col("_row.lang"), F.col("lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated and near-repeated lines; a document that this leaves without any text goes.

    Of like lines the first by doc_id (nulls first), then place, stays. Repeated rows are one document. A null or empty text
    loses no line and stays."""
    done = line_dedup.dedup_lines(_carried(docs, "doc_id", "text")).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return _changed(done, docs, text=F.col("text"), n_chars=F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component (0.8 or more alike on five-word shingles).

    Documents without an id, a text or words link with nothing and stay. All texts of a repeated id that stays do; of rows
    with one id and text, the smallest by the other columns stays."""
    stays = ngram_join.jaccard_components(docs, words=NEAR_WORDS, share=NEAR_SHARE).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(few(keep(stays, "stays"), F.lit(16)), "doc_id", "left_semi")
    # Only rows of repeated ids meet; all others stay where they lie.
    twice = few(keep(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1 and doc_id is not null").select("doc_id"), "repeated"), F.lit(16))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in rest))).alias("_rest"))
    one = one.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns))
    single = kept.join(twice, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    return single.unionByName(one).unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts. A null text stays null, repeated rows stay, an empty table stays empty."""
    done = pii.annotate(_carried(docs, "text"), pii.fit(docs))
    text = pii.masked(F.col("text"), F.col("spans"))
    return _changed(done, docs, text=text, n_chars=F.length(text).cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences; a null text counts as empty, repeated rows are
    documents of their own."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.assign_sequences(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packed)]

#: No SQL: MinHash, the language model and the tokenizer aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
