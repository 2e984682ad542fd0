"""One table of samples from navigation and from video conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mixed_corpus(navigation: DataFrame, conversations: DataFrame) -> DataFrame:
    """Navigation samples and conversation items in one shape.

    ``kind, source, sample_id, prompt, response, images, n_images``.
    ``navigation`` as :func:`trailframe.operators.samples.build_samples` gives
    it, ``conversations`` as
    :func:`trailframe.operators.conversations.flatten_items` does.  Pictures of
    a navigation sample are paths; those of a conversation are frames of its
    video, of which only the number is known here.
    """
    key = [c for c in ("document", "task_idx", "step") if c in navigation.columns]
    first = navigation.select(
        F.lit("navigation").alias("kind"),
        F.col("root").alias("source"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in key]).alias("sample_id"),
        "prompt",
        "response",
        "images",
        F.size("images").alias("n_images"),
    )
    second = conversations.select(
        F.lit("conversation").alias("kind"),
        "source",
        F.col("item_id").alias("sample_id"),
        "prompt",
        "response",
        F.array().cast("array<string>").alias("images"),
        "n_images",
    )
    return first.unionByName(second)
