"""The corpus pipeline: quality rules, near-duplicate join, suffix-array dedup, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written and read back as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textvane.llm import jaccard, mixing, packing, quality, suffixes
from textvane.session import stage
from textvane.sources.tables import read_table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the compression bands."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group linked by five-word shingles at 0.8."""
    return jaccard.keep_one(docs, jaccard.Rule(5, 80, 100))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one has."""
    return _counted(suffixes.strip_repeats(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix at weights 1, 2, 3 draws them: left out, once, or up to three times."""
    return _counted(mixing.mixed_docs(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each drawn document lies in sequences of 1024 tokens."""
    return packing.pack(docs, payload=F.crc32).withColumnRenamed("payload", "ids_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("packing", packed_sequences),
]

# Compression, suffix order, seeded draws and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
