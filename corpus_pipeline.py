"""The corpus pipeline: five operators, each working on all that the one before it kept.

1. The quality classifier drops the documents it scores below one half.
2. Exact deduplication keeps one of each group of equal texts.
3. MinHash near-deduplication (five-word shingles, similarity of 0.8 or more) keeps one of each component.
4. Mixing repeats smaller sources so that the corpus reaches its target weights; no document is left out.
5. Best-fit packing places the pieces of all documents in sequences of 2,048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, near_dedup, packing, quality
from tidemark.llm.common import documents, stored, table


def good_pages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("quality classifier", good_pages), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Trained models, hashes and packing have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, "pipeline")
    return docs
