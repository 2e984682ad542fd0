"""Image stores and image files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANY_SCENE = "*"


def load_image_files(spark: SparkSession, path: str, glob: str = "*.jpg") -> DataFrame:
    """Files below ``path`` as ``(path, length, bytes)``.

    The content column is read only where a query uses it.  Spark does not list
    empty files, so they show up as missing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return files.select("path", "length", F.col("content").alias("bytes"))


def load_image_store(spark: SparkSession, path: str) -> DataFrame:
    """A key/value image table ``(store, key, bytes)`` kept as Parquet.

    ``store`` is a scene id, or ``*`` for a store that serves every scene.
    """
    return spark.read.schema("store STRING, key STRING, bytes BINARY").parquet(path)
