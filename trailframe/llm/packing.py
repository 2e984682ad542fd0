"""Packing token sequences by minimum bin slack.

A document is cut into pieces of the sequence length; only its last piece is
shorter.  Whole pieces are sequences of their own.  The short pieces are dealt
to groups of bounded size, and each group is packed by minimum bin slack: the
longest piece left opens a window; a subset-sum dynamic program over the
multiset of lengths, one bit per reachable fill, finds the fill closest to the
capacity; the lengths used are backtracked and the pattern is repeated as often
as the counts allow.

Texts are read once and never shuffled; the shuffle holds one small row per
short piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import text_of
from trailframe.llm.encoding import KEPT_WORDS, Encoder
from trailframe.session import write_through

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 20_000


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length fill ``capacity`` best.

    ``counts`` holds the lengths available, tried from the longest.  Bit ``s``
    of ``reach`` is set if a fill of ``s`` can be made; multiples of a length
    enter as powers of two, so that every number up to its count can be made.
    """
    if capacity <= 0:
        return {}
    limit = (1 << (capacity + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(times, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & limit
            left -= n
            times *= 2
        if reach >> capacity & 1:
            break
    fill = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> fill & 1:
            used[length] = used.get(length, 0) + n
            fill -= length * n
    return used


def patterns(counts: dict[int, int], window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns of lengths and how often each is used, until all lengths are placed."""
    counts = dict(counts)
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        used = fullest(counts, window - longest)
        for length, n in used.items():
            counts[length] -= n
            if not counts[length]:
                del counts[length]
        used[longest] = used.get(longest, 0) + 1
        times = min(counts.get(length, 0) // n for length, n in used.items())
        for length, n in used.items() if times else ():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        yield used, times + 1


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; pieces are sorted by length."""
    values, starts, counts = np.unique(lengths, return_index=True, return_counts=True)
    next_of = dict(zip(values.tolist(), starts.tolist()))
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    n = 0
    for used, times in patterns(dict(zip(values.tolist(), counts.tolist())), window):
        at = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                k = next_of[length]
                next_of[length] = k + times
                sequence[k : k + times] = np.arange(n, n + times)
                offset[k : k + times] = at
                at += length
        n += times
    return sequence, offset


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces_of(docs: DataFrame, vocabulary: str, window: int, end_id: int, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of all documents, in whole texts."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column("doc_id").to_pylist()
            texts = (t.as_py() for t in batch.column("text"))
            for doc_id, ids in zip(names, Encoder.of(vocabulary, kept_words).encode(texts)):
                ids += end
                total = len(ids) // 4
                for s in range(0, total, window):
                    part = ids[4 * s : 4 * (s + window)]
                    rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), total))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(cut, _PIECES)


def pack(
    docs: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    kept_words: int = KEPT_WORDS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null text counts as empty; every document has at least the end id.  A
    null ``doc_id`` and repeated rows are packed like any other.  Further
    columns are ignored; an empty table gives no rows.
    """
    # Written with a row number, so that groups do not depend on a key that may be repeated.
    pieces = write_through(
        pieces_of(docs, vocabulary, window, end_id, kept_words).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    whole = pieces.where(F.col("length") == window).select(
        *pieces.columns[:-1], (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    short = pieces.where(F.col("length") < window)
    groups = max(1, -(-short.count() // group_pieces))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "row")])
        sequence, offset = place(table.column("length").to_numpy(), window)
        # Groups have far fewer than 2 ** 24 sequences; even ids, as whole pieces take odd ones.
        named = {"sequence_id": 2 * (table.column("pack").to_numpy() * (1 << 24) + sequence), "offset": offset}
        placed = table.select(_NAMES)
        for name, values in named.items():
            placed = placed.append_column(name, pa.array(values, pa.int64()))
        return placed

    packed = (
        short.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .groupBy("pack")
        .applyInArrow(fill, f"{_PIECES}, sequence_id bigint, offset bigint")
    )
    return whole.unionByName(packed)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
