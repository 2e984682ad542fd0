"""Video conversations: frame plan, turn flattening, content parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.config import VideoConfig
from trailframe.functions.geometry import spread_index


def frame_count(video: Column, image: Column, config: VideoConfig | None = None) -> Column:
    """Pictures an item yields: one for an image, else ``num_frames``."""
    config = config or VideoConfig()
    has_video = F.coalesce(F.length(video) > 0, F.lit(False))
    has_image = F.coalesce(F.length(image) > 0, F.lit(False))
    return F.when(~has_video & has_image, 1).otherwise(config.num_frames)


def video_frame_plan(videos: DataFrame, config: VideoConfig | None = None) -> DataFrame:
    """``(video columns, slot, frame_no, is_placeholder, reason)``.

    ``total_frames`` null stands for a video that was not found, 0 or less for
    one without readable frames; both get placeholders in every slot.
    """
    config = config or VideoConfig()
    total = F.col("total_frames")
    usable = F.coalesce(total > 0, F.lit(False))
    slots = F.sequence(F.lit(0), F.lit(config.num_frames - 1))
    frames = F.transform(
        slots, lambda slot: F.when(usable, spread_index(slot, total, config.num_frames))
    )
    reason = F.when(total.isNull(), "not_found").when(total <= 0, "no_frames")
    return videos.select("*", F.posexplode(frames).alias("slot", "frame_no")).select(
        "*", (~usable).alias("is_placeholder"), reason.alias("reason")
    )


def _human_text(value: Column, frames: Column, config: VideoConfig) -> Column:
    bare = F.replace(F.replace(value, F.lit("<video>\n"), F.lit("")), F.lit("<video>"), F.lit(""))
    tokens = F.repeat(F.lit(config.image_token), frames)
    return F.when(
        F.contains(value, F.lit("<video>")), F.concat(tokens, F.lit("\n"), bare)
    ).otherwise(value)


def flatten_turns(turns: Column, frames: Column, config: VideoConfig | None = None) -> tuple[Column, Column]:
    """Prompt and response of an ordered ``array<struct<speaker, value>>``.

    In-row: all human turns joined, the last gpt turn, other speakers ignored.
    """
    config = config or VideoConfig()
    human = F.filter(turns, lambda t: t["speaker"] == "human")
    prompt = F.array_join(F.transform(human, lambda t: _human_text(t["value"], frames, config)), "")
    answers = F.filter(turns, lambda t: t["speaker"] == "gpt")
    answer = F.get(F.reverse(answers), F.lit(0))["value"]
    return prompt, F.coalesce(answer, F.lit(""))


def flatten_items(items: DataFrame, config: VideoConfig | None = None) -> DataFrame:
    """Loaded conversation items to samples; needs no shuffle."""
    frames = frame_count(F.col("video"), F.col("image"), config)
    prompt, response = flatten_turns(F.col("turns"), frames, config)
    return items.select(
        "source",
        "item_idx",
        "item_id",
        F.col("video").alias("video_path"),
        frames.alias("n_images"),
        prompt.alias("prompt"),
        response.alias("response"),
    )


def flatten_conversation(turns: DataFrame, key: str = "conv_id", config: VideoConfig | None = None) -> DataFrame:
    """The same from a flat table ``(key, turn, speaker, value, n_frames)``.

    Turns of other speakers, and all but the last answer, do not leave the map
    side: answers go through ``max_by``, only human texts are collected, and
    those make up the prompt cell itself.
    """
    config = config or VideoConfig()
    text = _human_text(F.col("value"), F.col("n_frames"), config)
    human = F.col("speaker") == "human"
    answer = F.col("speaker") == "gpt"
    return turns.groupBy(key).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(human, F.struct(F.col("turn"), text.alias("text"))))),
                lambda t: t["text"],
            ),
            "",
        ).alias("prompt"),
        F.coalesce(F.max_by(F.when(answer, F.col("value")), F.when(answer, F.col("turn"))), F.lit("")).alias(
            "response"
        ),
        F.max("n_frames").alias("n_images"),
    )


def content_parts(samples: DataFrame, n_images: Column, token: str = "<image>") -> DataFrame:
    """Cut the prompt at image tokens: ``(…, part, type, text, image_idx)``.

    Text parts are non-empty; image parts last while there are images.
    """
    segments = F.split("prompt", rf"\Q{token}\E")
    parts = F.flatten(
        F.transform(
            segments,
            lambda text, i: F.array(
                F.when(
                    text != "",
                    F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("int").alias("image_idx")),
                ),
                F.when(
                    (i < F.size(segments) - 1) & (i < n_images),
                    F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), i.alias("image_idx")),
                ),
            ),
        )
    )
    kept = F.filter(parts, lambda p: p.isNotNull())
    others = [c for c in samples.columns if c != "prompt"]
    return samples.select(*others, F.posexplode(kept).alias("part", "_p")).select(
        *others, "part", "_p.type", "_p.text", "_p.image_idx"
    )
