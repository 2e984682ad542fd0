"""Balanced shards by sampled splitters.

Records are ordered by a key: a hash of the text, then the document id.  Equal
texts are neighbours and share a shard unless a shard boundary falls into the
group.  The law is ``bytes``: shards have nearly equal sizes.

* **Splitters.**  A record is drawn into the sample with a probability in
  proportion to its weight, by a hash of its id, so reruns draw the same ones.
  Every k-th key of the sorted sample is a splitter.  The sample has a fixed
  expected size, whatever the input; so has the broadcast list of splitters.
* **Overfull ranges.**  Exact weights per range are summed; ranges above twice
  the mean weight are sampled again, at a higher rate, and subdivided.
* **Shards.**  Prefix sums over the ranges give each range its place in the
  total; a window inside each range gives each record its exact place.  Shard
  boundaries fall at sixteenths of the total, so sizes differ by one record.

Texts are read once and never shuffled.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailframe.llm.common import text_of
from trailframe.session import write_through

SHARDS = 16
RANGES = 2048
SAMPLES_PER_RANGE = 8
# Cells of the leading key bits; a record meets only its own cell's splitters.
CELL_BITS = 12
# One range is sorted by one task; more rows than this take more ranges.
RANGE_ROWS = 1_000_000
MAX_RANGES = 65_536


def _cell(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CELL_BITS)


def _draw() -> Column:
    """A number in [0, 1) that depends on the record alone."""
    return F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(1 << 53)) / float(1 << 53)


def _key() -> Column:
    # Shifted to unsigned order, as the leading bits choose the cell.
    return F.struct(F.col("h").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")).alias("u"), F.col("tie"))


def pick_splitters(records: DataFrame, mean_weight: float, ranges: int) -> DataFrame:
    """About ``ranges`` splitters ``(h, tie)`` at weighted quantiles of ``records``."""
    rate = SAMPLES_PER_RANGE / max(mean_weight, 1e-9)
    sample = records.where(_draw() < F.col("weight") * rate).select("h", "tie", _key().alias("key"))
    ranked = sample.withColumn("n", F.row_number().over(W.orderBy("key")))
    return ranked.where(F.col("n") % SAMPLES_PER_RANGE == 0).select("h", "tie", "key").distinct()


def _locate(records: DataFrame, splitters: DataFrame) -> DataFrame:
    """The records with ``range``: how many splitters are at or below their key."""
    cells = splitters.groupBy(_cell(F.col("h")).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("key")).alias("inside")
    )
    before = F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    # A cell without splitters takes the count of the last cell before it.
    every = splitters.sparkSession.range(1 << CELL_BITS).select(F.col("id").alias("cell"))
    table = (
        every.join(F.broadcast(cells), "cell", "left")
        .select("cell", F.coalesce("n", F.lit(0)).alias("n"), "inside")
        .select("cell", F.coalesce(before, F.lit(0)).alias("below"), "inside")
    )
    at = F.coalesce(F.size(F.filter("inside", lambda s: s <= F.col("key"))), F.lit(0))
    return (
        records.withColumns({"cell": _cell(F.col("h")), "key": _key()})
        .join(F.broadcast(table), "cell")
        .withColumn("range", F.col("below") + F.when(F.col("inside").isNull(), 0).otherwise(at))
        .drop("cell", "below", "inside", "key")
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the number of UTF-8 bytes plus one; a null text has no bytes.
    Slots number the records of a shard from 0 without gaps, in key order.  A
    null ``doc_id`` comes first in its group.  Repeated rows take neighbouring
    slots.  Further columns are ignored; an empty table gives no rows.
    """
    text = text_of()
    records = write_through(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "records",
    )
    found = records.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    rows, total = found["n"], found["bytes"] or 0
    ranges = min(MAX_RANGES, max(ranges, -(-rows // RANGE_ROWS)))
    # Half the weight is bytes and half is rows, so that a range is bounded in both.
    per_byte, per_row = 0.5 / max(total, 1), 0.5 / max(rows, 1)
    weighed = records.withColumns(
        {"weight": F.col("size") * per_byte + F.lit(per_row), "tie": F.col("doc_id")}
    )
    mean = 1.0 / ranges
    splitters = write_through(pick_splitters(weighed, mean, ranges), "splitters")
    loads = _locate(weighed, splitters).groupBy("range").agg(F.sum("weight").alias("load"))
    overfull = write_through(loads.where(F.col("load") > 2 * mean), "overfull")
    if overfull.limit(1).count():
        # At most ranges / 2 ranges can be above twice the mean.
        inside = _locate(weighed, splitters).join(F.broadcast(overfull), "range", "left_semi")
        finer = pick_splitters(inside, mean / 4, ranges)
        splitters = write_through(splitters.unionByName(finer).distinct(), "splitters")
    placed = _locate(weighed, splitters).drop("weight")
    sums = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        "range",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_row"),
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("first_byte"),
    )
    order = W.partitionBy("range").orderBy(_key(), "size")
    running = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        placed.withColumns(
            {
                "_row": F.row_number().over(order) - 1,
                "_byte": F.coalesce(F.sum("size").over(running), F.lit(0)),
            }
        )
        .join(F.broadcast(starts), "range")
        .withColumns(
            {
                "place": F.col("first_row") + F.col("_row"),
                # The middle of the record decides.
                "shard": F.least(
                    F.floor((F.col("first_byte") + F.col("_byte") + F.col("size") / 2) * shards / F.lit(max(total, 1))),
                    F.lit(shards - 1),
                ).cast("int"),
            }
        )
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    ranked = write_through(ranked, "ranked")
    first = ranked.groupBy("shard").agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
