"""The corpus pipeline: each stage takes (spark, docs, sf_dir), and its result is written and read for the next one.

Every stage but the last returns the columns of ``docs``, whatever they are, beside which the last one returns its own. Rows
are kept or changed by their text (and doc_id where a stage says so): null and empty texts, null ids, very long texts and rows
that repeat pass through all stages, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberfold.llm import decontaminate, mixing, near_dup, quality_knn, secret_scan
from emberfold.llm.common import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a null text is judged as an empty one, without labels all are accepted."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five words, similarity 0.8).

    Texts without words and rows without an id are in no group; rows that repeat a doc_id are one document, kept or dropped together.
    """
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; items without words are held by none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and n_chars brought up to date where there is such a column."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes of each (taken) and its first place in the mix (first_slot)."""
    return mixing.mixed_rows(docs)


STAGES = [("quality", good_quality), ("near_dup", without_copies), ("decontaminate", decontaminated), ("secrets", without_secrets), ("mix", mixed)]

#: Neighbour votes in a learned space have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; between stages the lineage is cut."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
