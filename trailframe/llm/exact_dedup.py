"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when they are identical after deleting blanks.

* **Directory.**  The leading bits of a 64-bit hash of the blank-free text
  choose a directory cell.  All cells start at one depth; while some bucket
  holds more rows than its capacity the directory doubles: the bucket is split
  by its next bit, the others keep their depth (their cells share the bucket).
  The directory has at most ``2 ** MAX_DEPTH`` cells, so it may be broadcast
  at any scale.
* **Owner tasks.**  Rows are dealt by bucket; a task owns whole buckets, that
  is, whole ranges of hash values.  Within a bucket rows of one hash form a
  chain, and the chain is grouped by the bytes of the texts, so texts whose
  hashes collide stay apart.  A bucket that the deepest directory cannot split
  is only larger; it spills and loses nothing.
* **Hot hashes.**  A hash with very many rows (one text copied over and over)
  cannot be split by more bits.  Such hashes are counted beforehand; at most
  ``MAX_HOT_KEYS`` exist.  Their rows are dealt to several owners by a hash of
  the document id, and the owners' entries are merged.
* **Probe.**  Owners write one index entry per distinct text to the shared
  folder.  Documents look their text up by (hash, SHA-256): rows of a few dozen
  bytes, no texts.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailframe.llm.common import MAX_HOT_KEYS, hot_join, text_of, without_blanks, without_listed
from trailframe.session import write_through

MAX_DEPTH = 18
BUCKET_ROWS = 256


def _cell(hash_: Column) -> Column:
    """The directory cell: the leading bits of the hash."""
    return F.shiftrightunsigned(hash_, 64 - MAX_DEPTH)


def grow_directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Cells with their buckets: ``(cell, bucket, depth)``.

    ``keys(h, load)`` has one row per hash.  A bucket is named by its first
    cell; it covers ``2 ** (MAX_DEPTH - depth)`` cells.
    """
    cells = write_through(
        keys.groupBy(_cell(F.col("h")).alias("cell")).agg(F.sum("load").alias("load")), "cells"
    )
    rows = cells.agg(F.sum("load")).first()[0] or 0
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, rows) / capacity))))
    directory = cells.withColumn("depth", F.lit(depth))
    while depth < MAX_DEPTH:
        bucket = W.partitionBy("depth", _first_cell())
        full = F.sum("load").over(bucket) > capacity
        # The directory doubles: full buckets use one bit more.
        doubled = write_through(
            directory.withColumn("depth", F.col("depth") + full.cast("int")), "directory"
        )
        depth += 1
        grown = doubled.where(F.col("depth") == depth).limit(1).count()
        directory = doubled
        if not grown:
            break
    return directory.select("cell", _first_cell().alias("bucket"), "depth")


def _first_cell() -> Column:
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(MAX_DEPTH) - F.col("depth"))
    return F.col("cell") - F.pmod(F.col("cell"), size)


def build_index(texts: DataFrame, keys: DataFrame, total: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One entry per distinct text, written to the shared folder.

    ``texts(doc_id, n_points, h, plain)`` are the documents, ``keys(h, n)`` the
    rows per hash.  Entries: ``bucket, h, text_sha256, group_size, best``.
    """
    capacity = max(bucket_rows, math.ceil(2 * total / 2**MAX_DEPTH))
    hot_rows = max(capacity, total // MAX_HOT_KEYS)
    directory = grow_directory(
        keys.select("h", F.least(F.col("n"), F.lit(hot_rows)).alias("load")), capacity
    )
    hot = keys.where(F.col("n") > hot_rows).select("h", F.ceil(F.col("n") / hot_rows).alias("owners"))
    dealt = (
        texts.withColumn("cell", _cell(F.col("h")))
        .join(F.broadcast(directory.select("cell", "bucket")), "cell")
        .join(F.broadcast(hot), "h", "left")
        .withColumn("owner", F.pmod(F.xxhash64("doc_id"), F.coalesce("owners", F.lit(1))))
        .repartition("bucket", "owner")
    )
    chained = dealt.groupBy("bucket", "owner", "h", "plain").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"))).alias("best"),
    )
    entries = (
        chained.select("bucket", "h", F.sha2("plain", 256).alias("text_sha256"), "group_size", "best")
        .groupBy("bucket", "h", "text_sha256")
        .agg(F.sum("group_size").alias("group_size"), F.max("best").alias("best"))
    )
    return write_through(entries, "dedup-index")


def exact_dedup(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: the row that stays for its text, and whether it is this one.

    ``doc_id, keep_id, group_size, kept, text_sha256, n_points``.  Of equal
    texts the row with the most code points stays, then the one with the
    smallest ``doc_id``.  A null text counts as empty; empty and blank texts
    form one group.  A null ``doc_id`` ranks after all others.  Of rows that
    are repeated in full, one stays.  Further columns are ignored, an empty
    table gives no rows.
    """
    # Read as bytes of fixed meaning: only these two columns are used.
    used = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    texts = used.select(
        "doc_id", F.length("text").alias("n_points"), without_blanks(F.col("text")).alias("plain")
    ).withColumn("h", F.xxhash64("plain"))
    signatures = write_through(
        texts.select("doc_id", "n_points", "h", F.sha2("plain", 256).alias("text_sha256")), "signatures"
    )
    total = signatures.count()
    keys = write_through(signatures.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "hashes")
    index = build_index(texts, keys, total, bucket_rows)
    found = hot_join(
        signatures,
        index.select(
            "h",
            "text_sha256",
            "group_size",
            F.col("group_size").alias("weight"),
            F.bitwise_not(F.col("best.not_id")).alias("keep_id"),
            F.col("best.n_points").alias("keep_points"),
        ),
        ["h", "text_sha256"],
        "weight",
        total,
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    # Equal candidates are repetitions of one row.
    repeat = F.row_number().over(W.partitionBy("h", "text_sha256", "doc_id").orderBy("n_points"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_points"]
    stay = found.where(first).withColumn("kept", repeat == 1)
    go = found.where(~first).withColumn("kept", F.lit(False))
    return stay.select(*columns).unionByName(go.select(*columns))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Dropped documents are left out by their id, text digest and length
    (``without_listed``); of rows that are repeated in full, one stays.
    """
    found = exact_dedup(docs)
    keys = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_points").alias("_points")]
    verdict = write_through(
        found.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "verdict"
    )
    gone = verdict.where("not kept").select("_id", "_sha", "_points")
    text = text_of()
    keyed = docs.withColumns(
        {"_id_own": F.col("doc_id").cast("bigint"), "_sha_own": F.sha2(without_blanks(text), 256), "_points_own": F.length(text)}
    )
    match = F.col("_id_own").eqNullSafe(F.col("_id")) & F.expr("_sha_own = _sha") & F.expr("_points_own = _points")
    own, listed = ([F.col(c) for c in cs] for cs in (("_id_own", "_points_own", "_sha_own"), ("_id", "_points", "_sha")))
    rows = without_listed(keyed, gone, match, own, listed)
    if verdict.where("kept and rows > 1").limit(1).count():
        # Some kept row is repeated: number its repetitions.
        same = W.partitionBy("_id_own", "_sha_own", "_points_own").orderBy("_points_own")
        rows = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return rows.select(*docs.columns)
