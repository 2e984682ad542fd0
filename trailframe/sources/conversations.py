"""Video-conversation files: a JSON list of items with their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.sources.json_elements import json_elements

ITEM_SCHEMA = (
    "ARRAY<STRUCT<id: STRING, video: STRING, image: STRING, "
    "conversations: ARRAY<STRUCT<`from`: STRING, value: STRING>>>>"
)


def unreadable_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``source, reason`` of the files whose items are lost: not a readable list of items."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    items = F.from_json("value", ITEM_SCHEMA)
    # Null elements stand for items that are no objects.
    bad = F.when(items.isNull() | (F.json_array_length("value").isNull()), "unreadable_file").when(
        F.exists(items, lambda i: i.isNull()), "unreadable_item"
    )
    return files.select("source", bad.alias("reason")).where("reason is not null")


def load_conversations(spark: SparkSession, path: str) -> DataFrame:
    """One row per item: ``source, item_idx, item_id, video, image, turns``.

    ``item_id`` falls back to the position in the list.  Files are read in
    parallel, each whole; :func:`load_large_conversations` reads one file by many tasks.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"),
        F.posexplode(F.from_json("value", ITEM_SCHEMA)).alias("item_idx", "item"),
    )
    return _items(files)


def load_large_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``load_conversations`` for plain files of any size, read by many tasks.

    A file that is no sound list of objects is parsed whole, as by ``load_conversations``.
    """
    item = ITEM_SCHEMA[len("ARRAY<") : -1]
    rest, elements = json_elements(spark, path, 1, "", lambda text: F.from_json(text, item).isNotNull())
    first = rest.select(F.col("file").alias("source"), F.posexplode(F.from_json("text", ITEM_SCHEMA)).alias("item_idx", "item"))
    further = elements.select(F.col("file").alias("source"), F.col("idx").alias("item_idx"), F.from_json("text", item).alias("item"))
    return _items(first.unionByName(further))


def _items(files: DataFrame) -> DataFrame:
    return files.select(
        "source",
        F.col("item_idx").cast("bigint").alias("item_idx"),
        F.coalesce("item.id", F.col("item_idx").cast("string")).alias("item_id"),
        F.col("item.video").alias("video"),
        F.col("item.image").alias("image"),
        F.coalesce(
            F.transform(
                "item.conversations",
                lambda t: F.struct(
                    F.coalesce(t["from"], F.lit("")).alias("speaker"),
                    F.coalesce(t["value"], F.lit("")).alias("value"),
                ),
            ),
            F.array().cast("array<struct<speaker:string,value:string>>"),
        ).alias("turns"),
    )
