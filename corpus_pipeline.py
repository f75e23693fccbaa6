"""A training-data pipeline over ``documents``: toxicity, exact and near duplicates, secrets, packing.

Every stage works on all that the stage before it kept; its result is written as
Parquet and read again.  All stages but the last return the columns of their
input.

* toxicity: documents that the clause grammar predicts toxic go (weights learned
  from ``labels``);
* exact dedup: of equal normalised texts the smallest doc_id stays;
* SimHash near-dedup: of each group of linked fingerprints the smallest doc_id
  stays;
* secret scans: live secrets and copied examples are replaced in the text, and
  ``n_chars`` follows;
* packing: one row per piece of a document in a training sequence.

Cases: a null text is handled as an empty one by every stage and stays null in the
table; all null and empty texts are one group of equal texts, of which one row stays
(the smallest doc_id, null last); rows with a null doc_id, lang or source are kept or
dropped by their text alone (a null source or lang is an owner or repository of its
own); repeated rows are copies; texts of any length go through whole; an empty table
gives an empty result with the same columns; further columns, also ones with names
that stages use inside, are carried up to packing, whose result has its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import exact, neardup, packing, secrets, toxicity
from veilmark.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, shingle=neardup.SHINGLE_WORDS, distance=neardup.DISTANCE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned grammar nor the subword ids; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the pieces of the packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
