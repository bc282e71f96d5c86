"""Corpus pipeline: documents -> language ID -> exact dedup -> near-duplicate
join -> mixing -> packing.

Every stage but the last returns documents with the columns it was given;
the last returns the pieces of the packed documents. A null text counts as
empty, and the first stage drops it (no language); an empty table passes
through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from tidecast.llm.rows import stage as written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text some learned language explains."""
    return language_id.drop_unknown(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group."""
    return jaccard_join.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by the copies that the mix takes of them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", dedup_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned filters, MinHash groups, Newton steps and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written to the shared
    checkpoint folder and read again, so a lost executor repeats one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
