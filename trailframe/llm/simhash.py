"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most four bits have a middle: a value within
two bits of both.  Every fingerprint emits all variants within two flipped
bits; fingerprints that emit one variant are linked, and by the triangle
inequality every such collision is a true link.

* **Messages.**  All variants of a fingerprint that agree on the leading key
  bits travel as one row ``(key, fingerprint)``: the other flips can be redone
  at the receiver, which knows how many flips are left.  With 22 key bits a
  fingerprint sends 254 rows instead of 2,081.  The number of key bits grows
  with the logarithm of the number of fingerprints, which keeps the rows per
  key constant.
* **Receivers.**  Rows arrive sorted by key.  The few rows of an ordinary key
  are verified against each other; each pair is reported at one key only.  Rows
  of a crowded key redo their flips and meet on whole variants, which costs a
  constant per row.
* **Crowded keys.**  Very crowded keys are found beforehand by a histogram of
  fixed size, or by the receiver, which passes their rows on.  Their rows emit
  whole variants that are shuffled again.  A whole variant has at most 2,081
  distinct fingerprints, so no group is unbounded and no link is lost.

Equal fingerprints are grouped first, so copies of a text cost one fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import hot_join, text_of, without_listed
from trailframe.llm.components import components
from trailframe.operators.skew import marked_by_bitmap
from trailframe.session import write_through

SHINGLE_WORDS = 4
SEED = 42
HALF_RADIUS = 2
RADIUS = 2 * HALF_RADIUS

# Blocks up to FEW rows are compared directly, above BLOCK_ROWS shuffled again.
FEW = 48
# Key bits beyond the logarithm of the number of fingerprints; some 15 rows share a key.
SPARE_BITS = 4
BLOCK_ROWS = 4096
CELLS = 1 << 16
MAX_HOT_CELLS = 4096
_CHUNK = 1 << 18


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the blanks
    if not words:
        return 0
    plain = b" ".join(words)
    size = min(SHINGLE_WORDS, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - size] + 1))
    spans = list(zip(starts.tolist(), ends[size - 1 :].tolist()))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), _CHUNK):
        part = b"".join([digest(plain[a:b], SEED) for a, b in spans[at : at + _CHUNK]])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], signed], [*names, "fp"])


def fingerprints(docs: DataFrame, with_digest: bool = False) -> DataFrame:
    """``doc_id, fp`` for every row, with the text's ``digest`` between if asked for; ``fp`` is signed."""
    digest = [_digest().alias("digest")] if with_digest else []
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *digest, text_of().cast("binary").alias("text")
    )
    kept = "doc_id bigint, digest binary" if with_digest else "doc_id bigint"
    return texts.mapInArrow(_fingerprints, f"{kept}, fp bigint")


def _digest() -> Column:
    return F.unhex(F.md5(text_of()))


def _masks(bits: int, flips: int) -> list[int]:
    """All values of ``bits`` bits with at most ``flips`` ones."""
    return [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)]


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def messages(fps: DataFrame, key_bits: int) -> DataFrame:
    """``key, fp``: all values of the leading bits within two flips."""
    flips = F.explode(F.lit(_masks(key_bits, HALF_RADIUS)).cast("array<bigint>"))
    return fps.select("fp", flips.alias("flip")).select(
        F.shiftrightunsigned("fp", 64 - key_bits).bitwiseXOR(F.col("flip")).alias("key"), "fp"
    )


def _popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


class _Blocks:
    """Links among rows that share a key; one instance per task."""

    def __init__(self, key_bits: int, block_rows: int):
        self.low_bits = np.uint64(64 - key_bits)
        self.low_mask = np.uint64((1 << (64 - key_bits)) - 1)
        self.block_rows = block_rows
        masks = _masks(64 - key_bits, HALF_RADIUS)
        counts = [len(_masks(64 - key_bits, n)) for n in range(HALF_RADIUS + 1)]
        self.flips = [np.array(masks[:n], np.uint64) for n in counts]

    def few(self, key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the radius, each at its own key only."""
        found_a, found_b = [], []
        one = np.uint64(1)
        for d in range(1, most):
            i = np.flatnonzero((key[d:] == key[:-d]))
            if not len(i):
                break
            a, b = np.minimum(fp[i], fp[i + d]), np.maximum(fp[i], fp[i + d])
            near = _popcount(a ^ b) <= RADIUS
            a, b, k = a[near], b[near], key[i][near]
            high = (a ^ b) >> self.low_bits
            first = high & (~high + one)
            second = (high ^ first) & (~(high ^ first) + one)
            own = (a >> self.low_bits) ^ np.where(_popcount(high) > HALF_RADIUS, first | second, np.uint64(0))
            at = own == k
            found_a.append(a[at])
            found_b.append(b[at])
        return _joined(found_a), _joined(found_b)

    def many(self, key: np.uint64, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours on each whole variant of one key."""
        left = HALF_RADIUS - _popcount((fp >> self.low_bits) ^ key).astype(np.int64)
        variants, owners = [], []
        for n, flips in enumerate(self.flips):
            mine = fp[left == n]
            variants.append(((mine & self.low_mask)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(mine, len(flips)))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variant, kind="stable")
        variant, owner = variant[order], owner[order]
        same = variant[1:] == variant[:-1]
        return owner[:-1][same], owner[1:][same]

    def links(self, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole blocks, rows sorted by key."""
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        some = np.repeat((sizes > 1) & (sizes <= FEW), sizes)
        a, b = self.few(key[some], fp[some], FEW)
        found_a, found_b = [a], [b]
        for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            a, b = self.many(key[s], fp[s : s + n])
            found_a.append(a)
            found_b.append(b)
        pairs = np.stack([_joined(found_a), _joined(found_b)], axis=1)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
        return pairs[:, 0], pairs[:, 1]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _rows(kind: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["linked", "a", "b"])


def _receiver(key_bits: int, block_rows: int):
    """Links (linked, fp, fp) and rows of too crowded keys (not linked, key, fp)."""

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(key_bits, block_rows)
        held_key = held_fp = np.zeros(0, np.uint64)
        passing: np.uint64 | None = None
        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy().view(np.uint64)))
            fp = np.concatenate((held_fp, batch.column("fp").to_numpy().view(np.uint64)))
            if passing is not None:
                n = int(np.searchsorted(key, passing, "right"))
                yield _rows(False, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                passing = None
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            held_key, held_fp = key[last:].copy(), fp[last:].copy()
            if len(held_key) > block_rows:
                passing = held_key[0]
                yield _rows(False, held_key, held_fp)
                held_key = held_fp = np.zeros(0, np.uint64)
            yield from _settle(blocks, key[:last], fp[:last])
        yield from _settle(blocks, held_key, held_fp)

    return receive


def _settle(blocks: _Blocks, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    crowded = np.repeat(sizes > blocks.block_rows, sizes)
    yield _rows(False, key[crowded], fp[crowded])
    yield _rows(True, *blocks.links(key[~crowded], fp[~crowded]))


def _whole_variants(rows: DataFrame, key_bits: int) -> DataFrame:
    """Links ``u, v`` among the rows ``(key, fp)`` of crowded keys."""
    low_bits = 64 - key_bits
    masks = _signed(_masks(low_bits, HALF_RADIUS))
    used = F.bit_count(F.shiftrightunsigned("fp", low_bits).bitwiseXOR(F.col("key")))
    flips = F.lit(masks).cast("array<bigint>")
    choices = F.lit(None).cast("array<bigint>")
    for n in range(HALF_RADIUS + 1):
        size = len(_masks(low_bits, HALF_RADIUS - n))
        choices = F.when(used == n, F.slice(flips, 1, size)).otherwise(choices)
    low = F.col("fp").bitwiseAND(F.lit((1 << low_bits) - 1).cast("bigint"))
    high = F.call_function("shiftleft", F.col("key"), F.lit(low_bits))
    variants = rows.withColumn("flip", F.explode(choices)).select(
        high.bitwiseOR(low.bitwiseXOR(F.col("flip"))).alias("variant"), "fp"
    )
    # At most 2,081 fingerprints lie within two bits of a variant.
    groups = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")


def links_of(fps: DataFrame, total: int, key_bits: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``u, v`` among the distinct fingerprints ``fps(fp)``, a written table of ``total`` rows.

    Not all pairs within the radius, but enough of them to connect each
    component: the same components as with all pairs.
    """
    if key_bits is None:
        key_bits = min(40, max(16, math.ceil(math.log2(max(2, total))) + SPARE_BITS))
    sent = messages(fps, key_bits).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(CELLS)))
    most = max(block_rows, total * len(_masks(key_bits, HALF_RADIUS)) // MAX_HOT_CELLS)
    # At most MAX_HOT_CELLS cells can hold more than that.
    hot = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("cell")
    hot = write_through(hot, "hot-cells")
    calm = sent.join(F.broadcast(hot), "cell", "left_anti").select("key", "fp")
    met = calm.repartition("key").sortWithinPartitions("key").mapInArrow(
        _receiver(key_bits, block_rows), "linked boolean, a bigint, b bigint"
    )
    met = write_through(met, "met")
    crowded = met.where("not linked").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    crowded = crowded.unionByName(sent.join(F.broadcast(hot), "cell", "left_semi").select("key", "fp"))
    linked = met.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return linked.unionByName(_whole_variants(crowded, key_bits))


def near_dedup(docs: DataFrame, key_bits: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    A null or empty text has no words and the fingerprint zero, and links like
    any other; ``component_id`` is the smallest ``doc_id`` of the component
    (null only if all are null).  Repeated rows share a component.  Further
    columns are ignored; an empty table gives no rows.
    """
    marked = write_through(fingerprints(docs), "fingerprints")
    rows = _with_head(marked, F.col("doc_id"), key_bits, block_rows)
    return rows.select("doc_id", _hex("fp").alias("fingerprint"), F.col("head").alias("component_id"))


def _with_head(marked: DataFrame, rank: Column, key_bits: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written rows with ``head``, the smallest ``rank`` of their component."""
    fps = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    fps = write_through(fps, "distinct")
    total = fps.count()
    roots = components(links_of(fps.select("fp"), total, key_bits, block_rows))
    placed = fps.join(roots.withColumnRenamed("v", "fp"), "fp", "left")
    placed = write_through(placed.select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "placed")
    heads = placed.groupBy("root").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("size"))
    named = write_through(hot_join(placed, heads, ["root"], "size", total).select("fp", "n", "head"), "named")
    return hot_join(marked, named, ["fp"], "n", marked.count())


def _hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns.

    The row with the smallest ``doc_id`` stays (null after all others), then the
    one with the smallest text digest.  The others are left out by id and
    digest (``without_listed``), so that unlike texts under one id, or without ids,
    are judged apart.  Of rows that repeat id and text, one stays.
    """
    marked = write_through(fingerprints(docs, with_digest=True), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    found = _with_head(marked, rank)
    keys = [F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")]
    verdict = found.groupBy(*keys).agg(F.max(rank == F.col("head")).alias("heads"), F.count(F.lit(1)).alias("rows"))
    verdict = write_through(verdict, "verdict")
    own = docs.withColumns({"_id_own": F.col("doc_id").cast("bigint"), "_digest_own": _digest()})
    match = F.col("_id_own").eqNullSafe(F.col("_id")) & F.expr("_digest_own = _digest")
    row_key, listed_key = ([F.col(c) for c in cs] for cs in (("_id_own", "_digest_own"), ("_id", "_digest")))
    rows = without_listed(own, verdict.where("not heads").select("_id", "_digest"), match, row_key, listed_key)
    repeated = verdict.where("heads and rows > 1").select("_id", "_digest")
    if repeated.limit(1).count():
        # Only rows that may be such are brought together, and each task sends one of a key.
        marked = marked_by_bitmap(rows, repeated, row_key, listed_key, "_maybe")
        again = marked.where("_maybe").dropDuplicates(["_id_own", "_digest_own"])
        rows = marked.where("not _maybe").unionByName(again)
    return rows.select(*docs.columns)
