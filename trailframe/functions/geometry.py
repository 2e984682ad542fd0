"""Geometry and number expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def euclidean(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """L2 distance of two points given as column lists of equal length."""
    squares = [(p - q) * (p - q) for p, q in zip(a, b, strict=True)]
    total = squares[0]
    for square in squares[1:]:
        total = total + square
    return F.sqrt(total)


def is_finite(value: Column) -> Column:
    """True for an ordinary number; false for null, NaN and the infinities."""
    return F.coalesce(
        ~F.isnan(value) & (value < F.lit(INFINITY)) & (value > F.lit(-INFINITY)), F.lit(False)
    )


def spread_index(slot: Column, total: Column, slots: int) -> Column:
    """The ``slot``-th of ``slots`` evenly spaced positions in 0..total-1.

    Rounded down, with the last slot pinned to the last position.
    """
    if slots == 1:
        return F.lit(0).cast("int")
    spacing = (total - 1).cast("double") / F.lit(float(slots - 1))
    return (
        F.when(slot == F.lit(slots - 1), total - 1)
        .otherwise(F.floor(slot.cast("double") * spacing))
        .cast("int")
    )


def grid_cell(value: Column, low: Column, high: Column, cells: Column) -> Column:
    """Index of the cell that holds ``value``; cut toward zero, not clipped.

    Null where the bounds have no extent.
    """
    size = F.abs(high - low) / cells
    return F.try_divide(value - low, size).cast("int")
