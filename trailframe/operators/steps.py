"""Per-step access and classification (in-row, no shuffle).

A step row holds its candidates as one array of
``struct<px struct<u,v>, world struct<x,y,z>, vis>`` and, because the rules
test them apart, the length of each of the three source lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.config import CURRENT_SCHEMA, STOP_ACTION, VISIBLE, NavConfig
from trailframe.functions.geometry import INFINITY, euclidean


def task_keys(frame: DataFrame) -> list[str]:
    """What identifies a task: its root, its document if the rows name it, its place there."""
    return [c for c in ("root", "document", "task_idx") if c != "document" or c in frame.columns]


# -- access -----------------------------------------------------------------


def explode_steps(tasks: DataFrame) -> DataFrame:
    """One row per (task, step).

    A missing array, a short array and a null element all read as the default.
    """
    at_step = tasks.select("*", F.posexplode("actions").alias("step", "action"))

    def item(name: str) -> Column:
        return F.get(F.col(name), F.col("step"))

    def items(name: str) -> Column:
        return F.coalesce(item(name), F.array().cast(tasks.schema[name].dataType.elementType))

    def flag(name: str) -> Column:
        return F.coalesce(item(name), F.lit(False))

    listed = at_step.select(
        *task_keys(tasks),
        "step",
        "schema_version",
        "scene_id",
        "task_id",
        F.coalesce("instruction", F.lit("")).alias("instruction"),
        "action",
        items("pixel_coords").alias("_px"),
        items("world_coords").alias("_world"),
        items("visibility_status").alias("_vis"),
        item("trajectory_pixel").alias("traj_px"),
        item("trajectory_world").alias("traj_world"),
        item("trajectory_status").alias("traj_status"),
        item("trajectory_goal_distances").alias("goal_distance"),
        flag("trajectory_is_endpoint").alias("is_endpoint"),
        flag("floor_transition").alias("floor_transition"),
        item("expert_candidate_indices").alias("expert_idx"),
        item("floor_ids").alias("floor_id"),
        item("floor_heights").alias("floor_height"),
    )
    zipped = F.arrays_zip(
        F.col("_px").alias("px"), F.col("_world").alias("world"), F.col("_vis").alias("vis")
    )
    return listed.select(
        "*",
        F.size("_px").alias("n_pix"),
        F.size("_world").alias("n_world"),
        F.size("_vis").alias("n_vis"),
        zipped.alias("cands"),
    ).drop("_px", "_world", "_vis")


def is_valid_step(action: Column, schema_version: Column) -> Column:
    """Steps with an action; before the current schema STOP does not count."""
    return action.isNotNull() & ((schema_version >= CURRENT_SCHEMA) | (action != STOP_ACTION))


def valid_steps(steps: DataFrame) -> DataFrame:
    return steps.where(is_valid_step(F.col("action"), F.col("schema_version")))


def visible_frontiers() -> Column:
    """Pixels of the visible candidates, in order; none on a floor transition."""
    seen = F.filter(
        "cands", lambda c: c["px"].isNotNull() & F.coalesce(c["vis"] == VISIBLE, F.lit(False))
    )
    chosen = F.when(F.col("floor_transition"), F.slice(seen, 1, 0)).otherwise(seen)
    return F.transform(chosen, lambda c: c["px"])


def endpoint_flag() -> Column:
    """Endpoint label of a step; older schemas have none."""
    return (F.col("schema_version") >= CURRENT_SCHEMA) & F.coalesce("is_endpoint", F.lit(False))


# -- decisions --------------------------------------------------------------


def closest_candidate() -> Column:
    """``struct(dist, idx)`` of the candidate nearest to the trajectory point.

    World space where both sides have world points, else pixels.  Ties go to
    the first candidate; null where nothing has a finite distance.
    """
    by_world = F.col("traj_world").isNotNull() & (F.col("n_world") > 0)
    by_pixel = F.col("traj_px").isNotNull() & (F.col("n_pix") > 0)
    goal, target = F.col("traj_world"), F.col("traj_px")

    def distance(c: Column) -> Column:
        return F.when(
            by_world,
            euclidean([c["world"][n] for n in "xyz"], [goal[n] for n in "xyz"]),
        ).when(by_pixel, euclidean([c["px"][n].cast("double") for n in "uv"], [target[n] for n in "uv"]))

    ranked = F.transform(
        "cands", lambda c, i: F.struct(distance(c).alias("dist"), i.alias("idx"))
    )
    usable = F.filter(ranked, lambda r: F.coalesce(r["dist"] < INFINITY, F.lit(False)))
    return F.array_min(usable)


def match_threshold(config: NavConfig) -> Column:
    """Distance below which a nearest candidate counts as a match."""
    return F.when(F.col("traj_world").isNotNull(), config.distance_threshold).otherwise(
        config.pixel_distance_threshold
    )


def _is_current() -> Column:
    return F.col("schema_version") >= CURRENT_SCHEMA


def _sees_target() -> Column:
    return (
        endpoint_flag()
        & F.coalesce(F.col("traj_status") == VISIBLE, F.lit(False))
        & F.col("traj_px").isNotNull()
    )


def _visible_at(index: Column) -> Column:
    return F.coalesce(F.get(F.col("cands"), index)["vis"] == VISIBLE, F.lit(False))


def classify_steps(steps: DataFrame, config: NavConfig | None = None) -> DataFrame:
    """Add ``mode``, ``label`` and ``coord_supervised`` to every step.

    ``mode`` is null where the action is.  ``label`` is the pixel of a target
    or frontier; a frontier without pixel leaves it null, which the validation
    reports.  ``coord_supervised`` is close to, but not the same as, ``mode in
    (target, frontier)``: below the current schema an expert index out of range
    makes the mode search for the nearest candidate, while the flag stays off.
    """
    config = config or NavConfig()
    expert = F.col("expert_idx")
    in_range = F.coalesce((expert >= 0) & (expert < F.col("n_pix")), F.lit(False))
    near = F.col("_near")
    near_enough = F.coalesce(near["dist"] < match_threshold(config), F.lit(False))

    searched = steps.withColumn("_near", F.when(~_is_current(), closest_candidate()))
    matched = searched.withColumn(
        "_match",
        F.when(in_range, expert).when(~_is_current() & near_enough, near["idx"]),
    )
    mode = (
        F.when(F.col("action").isNull(), F.lit(None).cast("string"))
        .when(F.col("action") == STOP_ACTION, F.lit("stop"))
        .when(F.col("floor_transition"), F.lit("action"))
        .when(_sees_target(), F.lit("target"))
        .when(F.col("_match").isNotNull() & _visible_at(F.col("_match")), F.lit("frontier"))
        .otherwise(F.lit("action"))
    )
    flagged = F.when(expert.isNotNull(), expert).when(~_is_current() & near_enough, near["idx"])
    supervised = (
        F.coalesce(F.col("action") != STOP_ACTION, F.lit(False))
        & ~F.col("floor_transition")
        & (
            _sees_target()
            | (
                F.coalesce(
                    (F.col("_flagged") >= 0)
                    & (F.col("_flagged") < F.col("n_pix"))
                    & (F.col("_flagged") < F.col("n_vis")),
                    F.lit(False),
                )
                & _visible_at(F.col("_flagged"))
            )
        )
    )
    label = F.when(F.col("mode") == "target", F.col("traj_px")).when(
        F.col("mode") == "frontier", F.get(F.col("cands"), F.col("_match"))["px"]
    )
    return (
        matched.withColumn("mode", mode)
        .withColumn("_flagged", flagged)
        .withColumn("coord_supervised", supervised)
        .withColumn("label", label)
        .drop("_near", "_match", "_flagged")
    )
