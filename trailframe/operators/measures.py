"""Navigation measures per episode, final and running.

Input is one row per (episode, step); step 0 is the state at reset.  Columns
are only needed by the measures that use them:
``x, y, z`` position, ``distance_to_goal``, ``success``, ``spl``.

A measure is a partial aggregate over a block of steps and a merge of the
partial results.  That form serves the batch result, the running values and
the streaming operator alike, and an episode of any length is spread over as
many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.geometry import INFINITY, euclidean
from trailframe.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    across_blocks,
    attach_carry,
    preceding,
    running,
    with_block,
    within_block,
)

# ---------------------------------------------------------------------------
# Fixed value: distance in metres below which an episode counts as a success
# at its best point.
# ---------------------------------------------------------------------------
ORACLE_SUCCESS_DISTANCE = 3.0
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Measure:
    """``partial`` aggregates rows of a block; ``final`` merges the blocks.

    ``final`` gets the name of the partial column.  Rows offer ``_leg``, the
    distance from the previous step (0 at the first row of a block; the legs
    between blocks are added to the first partial of the following block).
    """

    name: str
    needs: tuple[str, ...]
    partial: Column
    final: Callable[[str], Column]


def _number(name: str) -> Column:
    """The column, NaN read as missing: a NaN never wins a minimum or maximum."""
    return F.when(~F.isnan(name), F.col(name))


def _start_distance() -> Column:
    return F.max(F.when(F.col("step") == 0, F.col("distance_to_goal")))


def standard_measures() -> dict[str, Measure]:
    """The built-in measures, by name."""
    distance = _number("distance_to_goal")
    near = F.coalesce(distance < ORACLE_SUCCESS_DISTANCE, F.lit(False))
    listed = [
        Measure("path_length", ("x", "y", "z"), F.sum("_leg"), lambda p: F.sum(p)),
        Measure(
            "oracle_navigation_error",
            ("distance_to_goal",),
            F.min(distance),
            lambda p: F.coalesce(F.min(p), F.lit(INFINITY)),
        ),
        Measure(
            "oracle_success",
            ("distance_to_goal",),
            F.max(near.cast("double")),
            lambda p: F.max(p),
        ),
        Measure(
            "oracle_spl",
            ("spl",),
            F.max(F.when(F.col("step") > 0, _number("spl"))),
            lambda p: F.greatest(F.max(p), F.lit(0.0)),
        ),
        Measure(
            "pl",
            ("x", "y", "z", "distance_to_goal", "success"),
            F.struct(_start_distance().alias("start"), F.sum("_leg").alias("path")),
            lambda p: pl_ratio(F.max(f"{p}.start"), F.sum(f"{p}.path")),
        ),
        Measure(
            "steps_taken",
            (),
            F.count_if(F.col("step") > 0).cast("double"),
            lambda p: F.sum(p),
        ),
    ]
    return {m.name: m for m in listed}


def pl_ratio(start: Column, path: Column) -> Column:
    """Start distance over the longer of start distance and path travelled.

    Null for an episode that starts at the goal and never moves.
    """
    return F.try_divide(start, F.greatest(start, path))


def spl(success: Column, start: Column, path: Column) -> Column:
    """Success weighted by path length, for inputs that lack the column."""
    return success.cast("double") * pl_ratio(start, path)


def _chosen(names: Sequence[str] | None, extra: Sequence[Measure]) -> list[Measure]:
    known = standard_measures()
    unknown = [n for n in names or () if n not in known]
    if unknown:
        raise ValueError(f"unknown measures: {', '.join(unknown)}")
    return [known[n] for n in (known if names is None else names)] + list(extra)


def _check_inputs(steps: DataFrame, measures: Sequence[Measure]) -> None:
    for measure in measures:
        missing = [c for c in measure.needs if c not in steps.columns]
        if missing:
            raise ValueError(f"measure {measure.name} needs {', '.join(missing)}")


def _position() -> Column:
    return F.struct("x", "y", "z")


def _leg(a: Column, b: Column) -> Column:
    return F.coalesce(euclidean([a[n] for n in "xyz"], [b[n] for n in "xyz"]), F.lit(0.0))


def with_legs(steps: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks, and the distance from the previous step of the same block."""
    blocked = with_block(steps, "step", block_rows)
    previous = F.lag(_position()).over(within_block(keys, "step"))
    return blocked.withColumn("_leg", _leg(previous, _position()))


def block_partials(legs: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per block: partial measures and the block's end positions."""
    ends = [
        F.min_by(_position(), "step").alias("_first"),
        F.max_by(_position(), "step").alias("_last"),
    ]
    return legs.groupBy(*keys, BLOCK).agg(*[m.partial.alias(m.name) for m in measures], *ends)


def merge_partials(partials: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Final measures per episode from its blocks, links between them added."""
    before = F.lag("_last").over(across_blocks(keys))
    linked = partials.withColumn("_link", _leg(before, F.col("_first")))
    for m in measures:
        if m.name == "path_length":
            linked = linked.withColumn(m.name, F.col(m.name) + F.col("_link"))
        elif m.name == "pl":
            linked = linked.withColumn(
                m.name,
                F.struct(F.col("pl.start").alias("start"), (F.col("pl.path") + F.col("_link")).alias("path")),
            )
    return linked.groupBy(*keys).agg(*[m.final(m.name).alias(m.name) for m in measures])


def measure_table(
    steps: DataFrame,
    names: Sequence[str] | None = None,
    extra: Sequence[Measure] = (),
    keys: Sequence[str] = ("episode_id",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The chosen measures of every episode, in one pass.

    Without a position-based measure no row is shuffled at all: the partial
    aggregates are made where the rows are read.
    """
    measures = _chosen(names, extra)
    _check_inputs(steps, measures)
    if any("x" in m.needs for m in measures):
        partials = block_partials(with_legs(steps, keys, block_rows), keys, measures)
        return merge_partials(partials, keys, measures)
    blocked = with_block(steps, "step", block_rows)
    partials = blocked.groupBy(*keys, BLOCK).agg(*[m.partial.alias(m.name) for m in measures])
    return partials.groupBy(*keys).agg(*[m.final(m.name).alias(m.name) for m in measures])


def running_measures(
    steps: DataFrame, keys: Sequence[str] = ("episode_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All measures after every step: the input rows with six more columns."""
    keys = list(keys)
    so_far = running(keys, "step")
    distance, moved = _number("distance_to_goal"), F.col("step") > 0
    near = F.coalesce(distance < ORACLE_SUCCESS_DISTANCE, F.lit(False)).cast("double")
    local = with_legs(steps, keys, block_rows).select(
        "*",
        F.sum("_leg").over(so_far).alias("_path"),
        F.min(distance).over(so_far).alias("_error"),
        F.max(near).over(so_far).alias("_near"),
        F.max(F.when(moved, _number("spl"))).over(so_far).alias("_spl"),
        F.sum(moved.cast("int")).over(so_far).alias("_moves"),
    )
    aggregates = [
        F.sum("_leg").alias("_b_path"),
        F.min("_error").alias("_b_error"),
        F.max("_near").alias("_b_near"),
        F.max("_spl").alias("_b_spl"),
        F.sum(moved.cast("int")).alias("_b_moves"),
        _start_distance().alias("_b_start"),
        F.min_by(_position(), "step").alias("_b_first"),
        F.max_by(_position(), "step").alias("_b_last"),
    ]

    def carry(summary: DataFrame) -> DataFrame:
        earlier = preceding(keys)
        link = _leg(F.lag("_b_last").over(across_blocks(keys)), F.col("_b_first"))
        linked = summary.withColumn("_link", link)
        whole = across_blocks(keys).rowsBetween(-(2**63), 0)
        return linked.select(
            *keys,
            BLOCK,
            (F.coalesce(F.sum(F.col("_b_path") + F.col("_link")).over(earlier), F.lit(0.0)) + F.col("_link")).alias("_c_path"),
            F.min("_b_error").over(earlier).alias("_c_error"),
            F.max("_b_near").over(earlier).alias("_c_near"),
            F.max("_b_spl").over(earlier).alias("_c_spl"),
            F.coalesce(F.sum("_b_moves").over(earlier), F.lit(0)).alias("_c_moves"),
            F.max("_b_start").over(whole).alias("_c_start"),
        )

    rows = attach_carry(local, keys, aggregates, carry)
    path = F.col("_path") + F.col("_c_path")
    return rows.select(
        *steps.columns,
        path.alias("path_length"),
        F.coalesce(F.least("_error", "_c_error"), F.lit(INFINITY)).alias("oracle_navigation_error"),
        F.greatest("_near", "_c_near").alias("oracle_success"),
        F.greatest("_spl", "_c_spl", F.lit(0.0)).alias("oracle_spl"),
        pl_ratio(F.col("_c_start"), path).alias("pl"),
        (F.col("_moves") + F.col("_c_moves")).cast("double").alias("steps_taken"),
    )
