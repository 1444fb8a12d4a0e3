"""Corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage takes rows with null ids, null, empty or very long texts, repeated rows and further columns, as the operator
it calls states, and gives an empty table for an empty one. Columns pass through as they are; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopflow.llm import line_dedup, near_dup, packing, quality, secrets
from stopflow.llm.common import saved, table

#: Near copies are linked at this many hundredths of similarity, lower than in op6.
NEAR = 80


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    kinds = dict(docs.dtypes)
    return docs.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from their labels, does not reject; a null text has the bias's score."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many pages of their source share; a null text stays null."""
    return _counted(line_dedup.drop_lines(docs))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id, once; without a doc_id all stay."""
    return near_dup.keep_one(docs, NEAR)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark; a null text stays null."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences; a null or empty text is one closing id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", keep_one),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]
#: Learned scores, shingle sets and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = saved(docs, f"stage{place}")
    return docs
