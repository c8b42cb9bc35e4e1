"""Corpus preparation in five stages, each an operator of ``gradelattice.llm``, written and read again between stages.

Every stage takes ``(spark, docs, sf_dir)``: the documents its predecessor kept, and the folder of the other tables.  All
but the last return the columns of ``documents``; a changed text brings its ``n_chars`` along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelattice.llm import decontaminate, language_id, minhash, pieces, pii
from gradelattice.session import stage

# Language models, sketches and pieces have no SQL form; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


BATCH_ROWS = 2_000  # documents sent to a Python worker at once


def _small_batches(spark: SparkSession) -> None:
    """Bound what a worker and its executor hold of a batch, unless the session bounds it already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; what they reject goes, as do texts without a letter.

    The models learn from the labelled documents of the stage's own input; without any, nothing is rejected.
    """
    _small_batches(spark)
    if not docs.where("lang is not null and text is not null").limit(1).count():
        return docs
    prefix = "language_id_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = language_id.identify(docs, language_id.fit(docs), prefix=prefix)
    return found.where(F.col(f"{prefix}accepted")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies: five-word shingles, similarity 0.8."""
    _small_batches(spark)
    return minhash.keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are little else go."""
    _small_batches(spark)
    return _recounted(decontaminate.remove_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data and secrets."""
    _small_batches(spark)
    return _recounted(pii.pseudonymise(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding gives the text back."""
    _small_batches(spark)
    model = pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), model, check_into="round_trip")
    return encoded.drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("personal_data", replace_personal_data),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
