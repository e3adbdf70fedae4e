"""From raw documents to training sequences: five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on everything that the one before
kept, and its result is written as Parquet and read again as the next one's
input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm import line_dedup, minhash, packing, quality_rules, secret_scan
from coverlens.llm.common import documents, pick, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return pick(docs, *COLUMNS)


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars anew, where the text has changed."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy web-1 keeps."""
    return quality_rules.filter_documents(_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    d = _columns(docs)
    return _measured(line_dedup.drop_lines(d, F.col("source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return minhash.deduplicate(_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    return secret_scan.redact(_columns(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack(_columns(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("packing", sequences),
]

#: Token ids and the order in which windows fill cannot be written as SQL; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
