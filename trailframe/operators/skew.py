"""Equi-joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot from this share of the left side on, so there are at most
# MAX_HOT_KEYS of them, and their list may be broadcast at any scale.
MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 1_000_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    total: int,
    how: str = "inner",
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Join on ``on``, splitting the left rows of a hot key over many tasks.

    ``right`` holds few rows per key; ``total`` is the number of left rows, or
    an upper bound of the rows of one key.  Keys of the left side are counted
    first (partial counts, key columns only).  Each hot key is given as many salts as
    it has portions of the hot limit; its left rows draw a salt by a hash of
    ``spread_by``, its right rows are repeated once per salt.  With no hot key
    the join is the ordinary one.
    """
    on = list(on)
    limit = max(min_hot_rows, total // MAX_HOT_KEYS)
    if total <= limit:
        return left.join(right, on, how)
    counts = left.groupBy(*on).count().where(F.col("count") > limit)
    hot = F.broadcast(
        counts.select(*on, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("_salts"))
    )
    salts = F.coalesce("_salts", F.lit(1))
    split = (
        left.join(hot, on, "left")
        .withColumn("_salt", F.pmod(F.hash(*spread_by), salts))
        .drop("_salts")
    )
    repeated = (
        right.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return split.join(repeated, [*on, "_salt"], how).drop("_salt")


def shuffled_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both grow with the input; neither passes through the driver.

    Spark takes a table's size from its compressed files and the columns' types, so it may
    take one for small, and broadcast it, that is many times larger in memory.
    """
    return left.join(right.hint("merge"), list(on), how)


# 8 MB, whatever is marked in it.
BITMAP_BITS = 1 << 26


def marked_by_bitmap(rows: DataFrame, keys: DataFrame, row_key: Sequence[Column], listed_key: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with the column ``name``: false where no row of ``keys`` can have the row's key.

    The hashes of the listed keys are marks in a bitmap of a fixed size, which is
    broadcast, so no row moves.  A key that is not listed may share its bit with a
    listed one; the more are listed, the more such rows are marked.
    """
    slot = lambda key: F.pmod(F.xxhash64(*key), F.lit(BITMAP_BITS))
    numbers = keys.select(slot(listed_key).alias("_slot"))
    bitmaps = numbers.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits")
    )
    placed = rows.withColumn("_slot", slot(row_key))
    found = placed.join(F.broadcast(bitmaps), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")
    bit = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    hit = F.expr("shiftright(_byte, _shift) & 1") == 1
    tested = found.withColumns({"_byte": byte, "_shift": bit % 8})
    return tested.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(name))
