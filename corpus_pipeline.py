"""Documents to a training mix: quality, exact copies, near copies, benchmark passages, mixing.

STAGES run in order; each takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of documents. run() writes what a stage returns to the
shared folder and reads it again, so that a lost executor never sets back more than one stage.

Each stage takes nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns of any name, as its docstring and its operator's define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from quillgraph.session import Scratch, prepare

#: A document stays when label 1 is at least this likely; the calibrated score balances both labels.
QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels of documents it is given.

    Null and empty texts are scored as texts without words; null doc_ids and null labels are not
    learned from. Repeated rows stay or go together. Without labels everything stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, ~quality.held_out(), QUALITY)


def keep_one_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts.

    A null text equals an empty one; null doc_ids rank last. Of rows that repeat doc_id and text one stays.
    """
    return exact_dedup.without_copies(docs)


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of near copies (five words, 0.8).

    Rows go by doc_id and text; null and repeated ids, null and empty texts, ties and extra columns
    as near_dedup.without_near_copies defines them.
    """
    return near_dedup.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark; others go as a whole.

    Null and empty texts stay, and so does everything if the benchmark is empty.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, in training order: a row a document.

    Null and empty texts have no words and come last; null sources are one source.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_one_exact),
    ("near_dedup", keep_one_near),
    ("decontaminate", drop_leaks),
    ("mix", mix_sources),
]

#: SQL can't fit the classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(prepare(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
