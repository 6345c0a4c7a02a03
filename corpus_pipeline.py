"""The corpus pipeline: five operators of ``hourgrid.llm`` in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written as Parquet in the shared checkpoint folder and read again as the next one's
documents.  All stages but the last return the columns of ``documents``; where a stage changes
a text, ``n_chars`` follows.  The last returns the packed pieces with their token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import line_dedup, packing, quality, secret_scan, simhash
from hourgrid.llm.common import remove, staged, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near-equal lines the first stays; a document may end up empty."""
    return _counted(line_dedup.dedup_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is replaced by a mark."""
    return _counted(secret_scan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, fuzzy lines, fingerprints and packing go beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``.  Null and empty texts, null and repeated
    ids, further columns of any name and empty tables are what the stages say of them; a table
    without documents gives no rows."""
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if done is not None:
            remove(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
