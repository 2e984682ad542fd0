"""Prompt, response and path texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.config import (
    ACTION_NAMES,
    ACTION_SYMBOLS,
    HISTORY_SENTENCE,
    STOP_TEXT,
    NavConfig,
)
from trailframe.functions.choice import seeded_choice


def image_path(
    root: Column, scene_id: Column, task_id: Column, step: Column, config: NavConfig
) -> Column:
    """``root/scene/task/rgb/step_0007.jpg``; longer step numbers keep all digits."""
    digits = step.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    frame = F.concat(F.lit("step_"), padded, F.lit(f".{config.image_ext}"))
    return F.concat_ws("/", root, scene_id, task_id.cast("string"), F.lit("rgb"), frame)


def action_display(code: Column, config: NavConfig) -> Column:
    """Name (or arrow) of an action code."""
    shown = ACTION_SYMBOLS if config.use_action_symbols else ACTION_NAMES
    text = F.concat(F.lit("UNKNOWN("), code.cast("string"), F.lit(")"))
    branches = F.when(code == 0, shown[0])
    for number, name in enumerate(shown[1:], start=1):
        branches = branches.when(code == number, name)
    return branches.otherwise(text)


def format_coord(pixel: Column) -> Column:
    """``(u, v)`` of a pixel struct."""
    return F.concat(
        F.lit("("),
        pixel["u"].cast("string"),
        F.lit(", "),
        pixel["v"].cast("string"),
        F.lit(")"),
    )


def format_coord_list(pixels: Column) -> Column:
    """``[(u, v), …]`` of an array of pixel structs, nulls left out."""
    present = F.filter(pixels, lambda p: p.isNotNull())
    return F.concat(F.lit("["), F.array_join(F.transform(present, format_coord), ", "), F.lit("]"))


def build_prompt(
    instruction: Column,
    frontiers: Column,
    history_size: Column,
    conjunction: Column,
    config: NavConfig,
) -> Column:
    """Fill the prompt template that fits the step.

    The markers are replaced one after the other, so a marker inside the
    instruction is treated like one of the template.
    """
    with_list = F.replace(
        F.lit(config.prompt_with_frontiers), F.lit("<frontiers_coord>"), format_coord_list(frontiers)
    )
    template = F.when(F.size(frontiers) > 0, with_list).otherwise(
        F.lit(config.prompt_without_frontiers)
    )
    images = F.repeat(F.lit(config.image_token), history_size)
    unseen = F.replace(template, F.lit(HISTORY_SENTENCE), F.lit(""))
    prompt = F.when(history_size > 0, F.replace(template, F.lit("<history>"), images)).otherwise(
        F.replace(unseen, F.lit("<history>"), F.lit(""))
    )
    prompt = F.replace(prompt, F.lit("<instruction>"), F.coalesce(instruction, F.lit("")))
    prompt = F.replace(prompt, F.lit("<conjunction>"), conjunction)
    return F.replace(prompt, F.lit("<image>"), F.lit(config.image_token))


def pick_conjunction(config: NavConfig, *keys: Column) -> Column:
    """One of the opening phrases, drawn by the sample's key."""
    phrases = F.array(*[F.lit(phrase) for phrase in config.conjunctions])
    number = seeded_choice(config.seed, F.lit(len(config.conjunctions)), *keys)
    return F.get(phrases, number.cast("int"))


def build_response(
    mode: Column, label: Column, action: Column, repeats: Column, config: NavConfig
) -> Column:
    """The answer text of a sample."""
    moves = F.array_join(F.array_repeat(action_display(action, config), repeats), " ")
    return (
        F.when(mode == "stop", F.lit(STOP_TEXT))
        .when(mode == "frontier", F.concat(F.lit(config.frontier_prefix + " "), format_coord(label)))
        .when(mode == "target", F.concat(F.lit(config.target_prefix + " "), format_coord(label)))
        .when(mode == "action", F.concat(F.lit(config.action_prefix + " "), moves))
    )


def trainable_ranges(mode: Column, response: Column, config: NavConfig) -> Column:
    """Character ranges of the answer that carry loss."""
    start = F.lit(0)
    if not config.prefix_trainable:
        start = (
            F.when(mode == "frontier", len(config.frontier_prefix))
            .when(mode == "target", len(config.target_prefix))
            .when(mode == "action", len(config.action_prefix))
            .otherwise(0)
        )
    return F.array(F.struct(start.alias("start"), F.length(response).alias("end")))
