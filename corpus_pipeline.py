"""The corpus pipeline: quality, lines, near copies, mixing, packing.

Each stage takes what the one before it kept, and all but the last return the columns of
``documents``. Their results are written to the shared folder and read back in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, near_dedup, packing, quality
from plumbline.llm.common import Scratch, table

#: Token shares of the languages after mixing.
TARGETS = {"en": 0.55, "de": 0.16, "fr": 0.16, "es": 0.13}


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document or line has, but for one edit at most."""
    return line_dedup.drop_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the languages have their shares; none is left out.

    Languages are learned from the rows that the labelled table covers.
    """
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("label")).join(covered, "doc_id")
    return mixing.repeat(docs, labelled, TARGETS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in windows of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("lines", first_lines),
    ("near_copies", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: Learned scores, rates and token ids cannot be given as SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
