"""A training corpus from raw documents: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and decides over all rows that its predecessor kept. All but the last return
the columns of documents; the last returns two sampled segmentations of each remaining text, with the texts they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import decontaminate, neardup, pieces, pseudonym, quality
from tallyweave.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows of the whole table ``documents``."""
    machine = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, machine)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more."""
    return neardup.without_near_duplicates(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced; n_chars follows the new text."""
    fresh = pseudonym.with_pseudonyms(docs, counts=False)
    return fresh.selectExpr(*("CAST(char_length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`"
                              for c in fresh.columns))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, sampled without replacement and decoded again; one row per document."""
    return pieces.gathered(docs, 2)


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pseudonyms", pseudonym_stage),
    ("segmentation", segmentation_stage),
]

#: Learned scores, keyed permutations and sampling are not SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
