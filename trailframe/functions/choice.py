"""Repeatable replacements for random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_number(seed: int, *keys: Column) -> Column:
    """A 60-bit number that depends only on the row's key and the seed.

    The same for every partitioning, so a recomputed task draws the same value.
    """
    text = F.concat_ws("|", *[key.cast("string") for key in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_choice(seed: int, choices: Column, *keys: Column) -> Column:
    """A number in 0..choices-1."""
    return F.pmod(seeded_number(seed, *keys), choices)
