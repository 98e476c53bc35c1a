"""A training corpus from documents in five stages, each one operator of tidemark.llm.

Rows are told apart by doc_id: rows that share one share every decision, rows without one pass the filters. Null and empty texts
are scored like others and packed as their end id alone; an empty table stays one. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, near_dedup, packing, quality_classifier, substring_dedup
from tidemark.llm.scratch import collected, forget, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_left: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables the stage before it worked with, as its output has been written by now. If it
    hasn't, and ``docs`` still reads them, they stay.
    """

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left and not any(p in x for x in docs.inputFiles() for p in _left):
            forget(spark, _left)
            _left.clear()
        with collected(_left):
            return f(spark, docs, sf_dir)

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scores = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)
    rejected = scores.filter("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    gone = near_dedup.near_duplicates(docs, percent=80, size=5).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that occur twice; the others keep their white space."""
    new = substring_dedup.remove_repeats(docs, n_words=35, carry=("lang", "source", "n_chars"), verbatim=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return new.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.05)
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens, with their ids."""
    return packing.pack(docs, width=1024)


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontaminated), ("packing", packed)]

#: No stage but the joins can be put in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    _left.clear()  # the result still reads the last stage's tables
    return docs
