"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_counts(tasks: DataFrame, samples: DataFrame) -> DataFrame:
    """Tasks and samples per source, and in total (``root`` null).

    Both sides are counted per source before they meet, so one large source
    costs no more than one partial row per input partition.
    """
    per_root = (
        tasks.groupBy("root")
        .agg(F.count(F.lit(1)).alias("tasks"), F.lit(0).cast("bigint").alias("samples"))
        .unionByName(
            samples.groupBy("root").agg(
                F.lit(0).cast("bigint").alias("tasks"), F.count(F.lit(1)).alias("samples")
            )
        )
    )
    return per_root.rollup("root").agg(F.sum("tasks").alias("tasks"), F.sum("samples").alias("samples"))
