"""Ordered computations over series of any length.

A window partitioned by the series key alone puts a whole series into one
task.  Here a series is cut into blocks of consecutive rows.  Windows run over
(key, block); one summary row per block goes through a second, far smaller
window over the key; and what each block needs from its predecessors (a
running total, the last row) or successors (the next few rows) is joined back.
The rows are shuffled once, by (key, block), which spreads a hot series over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trailframe.session import write_through

BLOCK = "block"
BLOCK_ROWS = 65_536


def with_block(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the blocks of a series that is ordered by the integer ``order``."""
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(block_rows)))


def within_block(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def running(keys: Sequence[str], *order: str) -> WindowSpec:
    """From the start of the block to the current row."""
    return within_block(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def across_blocks(keys: Sequence[str]) -> WindowSpec:
    """Window over the block summaries of one series, in order."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def preceding(keys: Sequence[str]) -> WindowSpec:
    """All earlier blocks of the series, the current one left out."""
    return across_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)


def attach_carry(
    rows: DataFrame,
    keys: Sequence[str],
    aggregates: Sequence[Column],
    carry: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Summarise each block, let ``carry`` scan the summaries, join the result.

    ``carry`` gets one row per (keys, block) with ``aggregates`` and returns
    the same rows with the columns to add to ``rows``.
    """
    summary = rows.groupBy(*keys, BLOCK).agg(*aggregates)
    return rows.join(carry(summary), [*keys, BLOCK])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rough: Column,
    name: str,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """0-based position of each row in its series, without one task per series.

    ``rough`` is a number that agrees with the first ``order`` column (a
    timestamp in seconds, say).  Its range is cut evenly, into so many pieces
    that one piece holds about ``rows_per_block`` rows of the whole table if
    they lie evenly; rows of one series with the same number stay together.
    """
    low, high, rows = df.agg(F.min(rough), F.max(rough), F.count(F.lit(1))).first()
    pieces = max(1, -(-rows // rows_per_block))
    width = max((float(high) - float(low)) / pieces, 1e-9) if rows else 1.0
    blocked = df.withColumn(
        BLOCK, F.floor((rough.cast("double") - F.lit(float(low or 0))) / F.lit(width))
    )
    local = blocked.withColumn("_local", F.row_number().over(within_block(keys, *order)))

    def offsets(summary: DataFrame) -> DataFrame:
        before = F.sum("_rows").over(preceding(keys))
        return summary.select(*keys, BLOCK, F.coalesce(before, F.lit(0)).alias("_before"))

    placed = attach_carry(local, keys, [F.count(F.lit(1)).alias("_rows")], offsets)
    return placed.withColumn(name, (F.col("_before") + F.col("_local") - 1).cast("int")).drop(
        BLOCK, "_local", "_before"
    )


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based rank of each row within its ``keys`` by ``order``, whatever the spread of values.

    Rows are dealt to sorted ranges whose ends Spark takes from a sample, so a
    large group lies in many ranges.  A row's rank is its place in its range plus
    the rows of its group in earlier ranges; only those counts, one per group and
    range, go through a window.  ``order`` should be unique within a group; rows
    that agree in it get different ranks in any order.
    """
    keys = list(keys)
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    marked = dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    # Written once: both uses below have to see the same ranges.
    marked = write_through(marked, "ranks")
    counts = marked.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col("_range").alias("_of_range"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_from"),
    )
    same = F.col("_range") == F.col("_of_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    ranked = marked.join(starts, same)
    return ranked.select(*df.columns, (F.col("_at") + F.col("_from")).alias(name))
