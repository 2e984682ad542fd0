"""Token ids in binary files of bit-plane shuffled, compressed blocks.

File layout (all integers little-endian):

* the magic ``b"TFPLANE1"``;
* blocks of up to ``BLOCK_IDS`` ids.  A block is transposed into planes: plane
  ``k`` holds byte ``k`` (or bit ``k``) of every id of the block.  Ids of a
  vocabulary leave the high planes zero and the low ones alike, so each plane
  is compressed on its own with zstandard; a plane of zeros takes no bytes;
* the document table: ids (with a null mark) and numbers of tokens, compressed;
* the chunk index as JSON (places, lengths and id counts of all blocks), its
  length as 8 bytes, and the magic again.

Files are written by the tasks that hold a range of document ids, under a
temporary name, and renamed when complete: a repeated task replaces the file by
an equal one, and readers only follow the manifest, which Spark commits.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailframe.llm.common import text_of
from trailframe.llm.encoding import Encoder
from trailframe.session import remove_at_exit, shared_folder, write_through

MAGIC = b"TFPLANE1"
BLOCK_IDS = 1 << 16
END_ID = 2


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block, lowest first; a plane of zeros is empty."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    else:
        planes = np.ascontiguousarray(raw.T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block of ``n`` from its planes."""
    width = -(-n // 8) if bits else n
    rows = np.zeros((32 if bits else 4, width), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            rows[k] = np.frombuffer(plane, np.uint8)
    if bits:
        raw = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; memory is bounded by a block and the document table."""

    def __init__(self, stream, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.packer = zstandard.ZstdCompressor(level=3)
        self.blocks: list[list] = []
        self.held: list[bytes] = []
        self.held_ids = 0
        self.docs: list[tuple[int | None, int]] = []
        self.n_ids = 0
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held_ids >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for s in range(0, whole, self.block_ids):
            block = ids[s : min(whole, s + self.block_ids)]
            packed = [self.packer.compress(p) if p else b"" for p in to_planes(block, self.bits)]
            self.blocks.append([self.at, len(block), [len(p) for p in packed]])
            self._put(b"".join(packed))
        rest = ids[whole:].tobytes()
        self.held, self.held_ids = ([rest] if rest else []), len(rest) // 4

    def close(self) -> None:
        self._flush(True)
        names = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        sizes = np.array([n for _, n in self.docs], "<i8").tobytes()
        table = self.packer.compress(names + nulls + sizes)
        index = {"bits": self.bits, "blocks": self.blocks, "docs": [self.at, len(table), len(self.docs)], "ids": self.n_ids}
        self._put(table)
        footer = json.dumps(index).encode()
        self._put(footer + len(footer).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads one file through its chunk index."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(tail[:8], "little")
        self.index = json.loads(source.read_at(n, size - 16 - n))
        self.unpacker = zstandard.ZstdDecompressor()

    def block(self, k: int) -> np.ndarray:
        at, n, lengths = self.index["blocks"][k]
        data = self.source.read_at(sum(lengths), at)
        planes, place = [], 0
        for length in lengths:
            part = data[place : place + length]
            planes.append(self.unpacker.decompress(part) if length else b"")
            place += length
        return from_planes(planes, n, self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents with their ids, one block at a time in memory."""
        at, length, n = self.index["docs"]
        table = self.unpacker.decompress(self.source.read_at(length, at))
        names = np.frombuffer(table, "<i8", n)
        nulls = np.frombuffer(table, np.uint8, n, 8 * n)
        sizes = np.frombuffer(table, "<i8", n, 9 * n)
        left, k = np.zeros(0, "<u4"), 0
        for name, null, size in zip(names.tolist(), nulls.tolist(), sizes.tolist()):
            parts = [left]
            have = len(left)
            while have < size:
                block = self.block(k)
                parts.append(block)
                have += len(block)
                k += 1
            joined = np.concatenate(parts) if len(parts) > 1 else left
            yield (None if null else name), joined[:size]
            left = joined[size:]


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = END_ID, bits: bool = False
) -> tuple[str, DataFrame]:
    """Writes token files in ascending ``doc_id`` order; gives their folder and manifest.

    ``folder`` is one that all executors share (a path or URI); without one the
    files are intermediate and go when the application ends.

    The manifest ``(file_no, file, n_docs, n_ids)`` is in file order, which is
    document order.
    """
    spark = docs.sparkSession
    given, folder = folder, folder or shared_folder(spark, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t) for b in batches for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        first = next(rows, None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"ids-{part:08d}.planes"
        unfinished = f"{root}/.{name}.{uuid.uuid4().hex}"
        names: list[int | None] = []

        def texts():
            names.append(first[0])
            yield first[1]
            for doc_id, text in rows:
                names.append(doc_id)
                yield text

        with fs.open_output_stream(unfinished) as stream:
            writer = PlaneWriter(stream, bits)
            for k, ids in enumerate(Encoder.of(vocabulary).encode(texts())):
                writer.add(names[k], ids + end)
            writer.close()
        fs.move(unfinished, f"{root}/{name}")
        columns = [[part], [name], [len(writer.docs)], [writer.n_ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file_no", "file", "n_docs", "n_ids"])

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", F.md5("text"))
    )
    manifest = ordered.mapInArrow(write, "file_no bigint, file string, n_docs bigint, n_ids bigint")
    manifest = write_through(manifest, "manifest")
    if not given:
        remove_at_exit(spark, folder)
    return folder, manifest


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files, one task per file."""
    files = max(1, manifest.count())
    # One row per file; the running sum is over files, not documents.
    before = F.sum("n_ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1))
    listed = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start")).repartition(files, "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as source:
                    held: list[tuple] = []
                    for doc_id, ids in PlaneReader(source).documents():
                        held.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(held) >= 10_000:
                            yield _listed(held)
                            held = []
                    yield _listed(held)

    return listed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of all documents and lists the documents from them.

    A null text counts as empty and has the end id only.  A null ``doc_id``
    comes first; documents of equal id are ordered by the digest of their text.
    Further columns are ignored; an empty table gives no rows and no files.
    """
    return read_token_files(*write_token_files(docs, vocabulary))
