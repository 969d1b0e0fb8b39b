"""A training-data pipeline over ``documents``: what is toxic or a copy goes, the rest is mixed and packed.

Each stage reads all that its predecessor kept, and writes what it keeps before the next one begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm.common import stored
from netquarry.llm.exact_dedup import drop_exact_duplicates
from netquarry.llm.mixing import apply_mix
from netquarry.llm.near_dedup import drop_near_duplicates
from netquarry.llm.packing import pack_documents
from netquarry.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from ``labels`` scores below the threshold."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of texts that are equal but for white space."""
    return drop_exact_duplicates(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of similarity 0.75 hold together."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: not at all, once or twice."""
    return apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_exact_copies),
    ("near_dedup", remove_near_copies),
    ("source_mixing", mix),
    ("best_fit_packing", pack),
]

# A learned lexicon, MinHash and packing cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
