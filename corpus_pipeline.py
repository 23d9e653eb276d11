"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Defined cases: documents whose text is null, empty or without a letter go in the first stage. Null ids are ids like any other, the last
to stay. Rows that repeat an id and a text are one document. Other columns may have any names and stay as they are until the last stage. An
empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.llm import language_id
from fieldlog.llm.common import discard, small_batches, table, written
from fieldlog.llm.exact_dedup import drop_exact_copies
from fieldlog.llm.near_dedup import drop_near_copies
from fieldlog.llm.packing import pack
from fieldlog.llm.pii import redact

#: Documents whose language the network gives a mean probability below this are rejected, as are those without a letter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    small_batches(spark)
    predict = language_id.predictor(language_id.learn(docs, ~language_id.held_out()))
    # A name of our own, so that no column of docs can clash with it.
    own = f"language {uuid.uuid4().hex}"
    found = docs.withColumn(own, predict(F.col("text")))
    return found.where((F.col(own)["lang_pred"] != language_id.UNKNOWN) & (F.col(own)["score"] >= LEAST_SCORE)).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return drop_exact_copies(docs, keep="min")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the smallest id."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: one row for each piece of a document, with its place."""
    return pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("near dedup", near_copies), ("PII", personal_data), ("packing", packing)]

#: A trained model, a random estimate and a tokenizer aren't expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
