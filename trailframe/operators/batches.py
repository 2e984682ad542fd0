"""From token ids to padded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.config import IGNORE_LABEL
from trailframe.functions.choice import seeded_number
from trailframe.functions.tokens import (
    attention_mask,
    loss_start,
    mask_labels,
    truncate_ids,
)

#: Ids that a task pads at once, or one row's.
PAD_IDS = 262_144


def label_samples(
    samples: DataFrame, marker: Column, response: Column, eos_id: int | None, max_length: int | None = None
) -> DataFrame:
    """Add ``input_ids`` (cut to ``max_length``, if given), ``labels`` and ``attention_mask`` to ``ids``.

    The parts are separate projections, so that each is computed once per row.
    """
    ids = F.col("ids") if max_length is None else truncate_ids(F.col("ids"), max_length)
    cut = samples.withColumn("input_ids", ids)
    started = cut.withColumn("loss_start", loss_start(F.col("input_ids"), marker, response))
    return started.select(
        *samples.columns,
        "input_ids",
        "loss_start",
        mask_labels(F.col("input_ids"), F.col("loss_start"), eos_id).alias("labels"),
        attention_mask(F.col("input_ids")).alias("attention_mask"),
    )


def _padded(flat: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, fill: int) -> pa.ListArray:
    """Rows of ``sizes`` in ``flat``, each continued with ``fill`` to its length."""
    ends = np.cumsum(lengths)
    out = np.full(int(ends[-1]), fill, flat.dtype)
    # Each value moves on by what the rows before its own were lengthened by.
    shift = np.repeat(ends - lengths - (np.cumsum(sizes) - sizes), sizes)
    out[np.arange(len(flat)) + shift] = flat
    return pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(out))


def pad_batches(
    samples: DataFrame,
    key: str,
    batch_size: int,
    pad_id: int,
    shards: int | None = None,
    seed: int = 42,
    by_length: bool = False,
    rows_per_shard: int = 65_536,
) -> DataFrame:
    """Group samples into batches and pad each to its longest member.

    Batches are formed inside hash shards: a shard lies in one task,
    and the same key always lands in the same batch; ``key`` is unique and not null.  The default number of
    shards grows with the table.  ``by_length`` orders a shard by length, which
    cuts padding; otherwise the order is pseudo-random.

    ``samples`` are read twice without ``shards``, first to count them: write them before if they are costly.
    Ids and labels are shuffled once, by shard, and sorted there.  The sorted rows
    then stream by, and a batch leaves when it is full, so its rows stay together in one
    file; a task pads rows of some ``PAD_IDS`` ids at a time.  The mask follows from the lengths.
    """
    if shards is None:
        shards = max(1, -(-samples.count() // rows_per_shard))
    number = seeded_number(seed, F.col(key))
    order = (["_size"] if by_length else []) + ["_number", key]
    rows = samples.select(key, "input_ids", "labels", F.size("input_ids").alias("_size"), number.alias("_number"))
    placed = rows.withColumn("shard", F.pmod("_number", F.lit(shards)))
    sorted_rows = placed.repartition("shard").sortWithinPartitions("shard", *order).drop("_number", "_size")
    fields = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    most = PAD_IDS

    def pad(group: pa.Table, first: int) -> pa.RecordBatch:
        """The batches of consecutive rows of one shard, the first of which has the number ``first``."""
        ids, labels = (group.column(c).combine_chunks() for c in ("input_ids", "labels"))
        sizes = ids.value_lengths().to_numpy().astype(np.int64)
        starts = np.arange(0, len(sizes), batch_size)
        batch = np.arange(len(sizes)) // batch_size
        lengths = np.maximum.reduceat(sizes, starts)[batch]
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        ones = np.ones(int(sizes.sum()), np.int32)
        columns = [
            group.column(key).combine_chunks(),
            group.column("shard").combine_chunks(),
            pa.array(first + batch, pa.int64()),
            _padded(flat(ids), sizes, lengths, pad_id),
            _padded(flat(labels), labels.value_lengths().to_numpy().astype(np.int64), lengths, IGNORE_LABEL),
            _padded(ones, sizes, lengths, 0),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "shard", "batch_id", "input_ids", "labels", "attention_mask"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, done = None, None, 0
        for part in parts:
            if not len(part):
                continue
            shards_here = part.column("shard").to_numpy()
            portion = np.cumsum(part.column("input_ids").value_lengths().to_numpy(), dtype=np.int64) // most
            edges = np.flatnonzero((np.diff(shards_here) != 0) | (np.diff(portion) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(part)]):
                if shards_here[a] != shard:
                    if held is not None and len(held):
                        yield pad(held, done)
                    held, shard, done = None, shards_here[a], 0
                piece = pa.Table.from_batches([part.slice(a, b - a)])
                held = piece if held is None else pa.concat_tables([held, piece])
                full = len(held) // batch_size * batch_size
                if full:
                    yield pad(held.slice(0, full), done)
                    held, done = held.slice(full), done + full // batch_size
        if held is not None and len(held):
            yield pad(held, done)

    schema = (
        f"`{key}` {fields[key]}, shard {fields['shard']}, batch_id bigint, input_ids {fields['input_ids']}, "
        f"labels {fields['labels']}, attention_mask array<int>"
    )
    return sorted_rows.mapInArrow(batches, schema)
