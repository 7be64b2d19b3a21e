"""A corpus pipeline: quality rules, line dedup, near duplicates, personal data and packing; each stage's result is a
written table that the next one reads.

Every stage takes an empty table (and gives an empty one), texts that are null, empty or very long, nulls in any other column,
equal rows, and further columns of any name, which all stages but the last pass on untouched:

* quality rules: null and empty texts have no words and go; a null source is a host of its own; equal rows stay or go together.
* line dedup: rows equal in doc_id and text are one document; a document that loses all its lines goes; n_chars is counted anew.
* near duplicates: of equal texts and near copies the row of the smallest doc_id stays, nulls last, then the smallest text hash, then
  the smallest other columns.
* pii: a null text stays null; n_chars is counted anew.
* packing: a null text is its end id alone; equal rows are packed once each; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailforge.llm import linededup, packing, pii, quality, simhash
from trailforge.llm.common import discard, documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines deleted; documents of which nothing stays go."""
    return linededup.filter_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("near duplicates", near_duplicates), ("pii", redact_pii), ("packing", pack)]

#: Packing solves a linear program, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"stage{k}")
            if before is not None:
                discard(before)  # nothing reads it any more
            before = docs
    return docs
