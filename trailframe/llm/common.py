"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.operators.skew import marked_by_bitmap

#: The blanks of every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

# A key is hot above this share of all rows, so at most so many keys are hot
# and their rows of the other side (one per key) may be broadcast.
MAX_HOT_KEYS = 10_000


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_blanks(text: Column) -> Column:
    """The text with every blank deleted."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words between blanks, as an array."""
    return F.array_remove(F.split(text, BLANK_RUN, -1), "")


def without_listed(rows: DataFrame, listed: DataFrame, match: Column, row_key: Sequence[Column], listed_key: Sequence[Column]) -> DataFrame:
    """``rows`` that ``match`` no row of ``listed``; the plan is the same for any number of these.

    A bitmap of the listed keys is broadcast.  Rows outside of it stay where they are;
    only the others, which are the listed ones and the few that share a bit with them, are
    shuffled and compared.  ``rows`` is read twice, ``listed`` too: pass written tables.
    """
    marked = marked_by_bitmap(rows, listed, row_key, listed_key, "_maybe")
    doubtful = marked.where("_maybe").drop("_maybe")
    stay = doubtful.join(listed.hint("merge"), match, "left_anti")
    return marked.where("not _maybe").drop("_maybe").unionByName(stay)


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    weight: str,
    total: int,
) -> DataFrame:
    """Inner join on ``on`` (nulls equal), safe for keys that hold a third of the left rows.

    ``right`` has one row per key (for every hot key of the left side too: without
    a row it could not be told, and its rows would be shuffled), and its column ``weight`` says how many rows
    the key has on the left; ``total`` is the number of left rows.  Keys with
    more than ``total / MAX_HOT_KEYS`` rows number at most ``MAX_HOT_KEYS``;
    their right rows are broadcast, and the left rows of such keys stay where
    they are.  All other keys are small and take a shuffled join.  The column
    ``weight`` is dropped.  ``left`` is read twice: pass a written table.
    """
    on = list(on)
    limit = total // MAX_HOT_KEYS
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in on],
        *[F.col(c) for c in right.columns if c not in on],
    )
    same = None
    for k in on:
        one = F.col(k).eqNullSafe(F.col(f"_right_{k}"))
        same = one if same is None else same & one
    keys = [f"_right_{k}" for k in on]
    hot = renamed.where(F.col(weight) > limit)
    cold = renamed.where(F.col(weight) <= limit)
    near = left.join(F.broadcast(hot), same, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), same, "left_anti")
    far = rest.join(cold, same, "inner")
    return near.unionByName(far).drop(weight, *keys)
