"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again,
and its decisions take effect: rejected documents and duplicates go, and the
mix repeats or drops documents.  All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trailframe.llm.exact_dedup import keep_first
from trailframe.llm.mixing import mixed_documents
from trailframe.llm.packing import pack
from trailframe.llm.quality import kept_documents
from trailframe.llm.simhash import one_per_group
from trailframe.session import write_through


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with whole texts."""
    return kept_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, twice where it takes them twice."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    # A smaller word table than by default: executors still hold what the earlier stages left.
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_words=150_000)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints and token ids are not expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
