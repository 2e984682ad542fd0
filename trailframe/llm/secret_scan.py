"""Secret scans: known forms by pattern, random strings by their token efficiency.

A byte-pair vocabulary was fitted to text that people write, so words take few
tokens and random strings many.  A run of key characters that needs a token for
less than ``max_ratio`` characters is reported as ``random``, unless it is a
known digest or an identifier.  Three known forms (``assign``, ``access``,
``hex``) are found by pattern and always reported; a run that touches one of
their spans is not reported again.

Arrow's regular expressions sort out the texts that can hold a match; only those
are searched in Python.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import text_of

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
#: Characters per token below which a run counts as random.
MAX_RATIO = 1.9
#: Runs are counted in pieces, so that a blob of any length takes linear time.
_PIECE = 512

# The known forms.
_KEYWORDS = r"(?:password|passwd|secret|token|api_?key)"
_ASSIGN = re.compile(_KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LEAST = {"assign": 6, "access": 20}

_ASSIGN_FILTER = "(?i)" + _KEYWORDS + r"""["']?\x20*[:=]"""
_RUN_CLASS = "[A-Za-z0-9+/_=-]"

# Digests by length in hexadecimal digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
# A part of an identifier: a word in any case, a number, or a word with a short number.
_PART = re.compile(r"[A-Za-z]*|[0-9]+|[A-Za-z]+[0-9]{1,4}|[0-9]{1,4}[A-Za-z]{1,2}")
_JOINTS = re.compile(r"[+/_=-]")


def known_digest(run: str) -> bool:
    """Whether ``run`` is a digest or id in a published form."""
    plain = len(run) in _DIGEST_LENGTHS and _HEX_ONLY.fullmatch(run)
    return bool(plain or _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run))


def identifier(run: str) -> bool:
    """Whether ``run`` consists of words and numbers only, as names, paths and dates do."""
    return all(_PART.fullmatch(part) for part in _JOINTS.split(run))


class Scanner:
    """Finds spans in one text; kept per worker process."""

    _made: dict[tuple, Scanner] = {}

    def __init__(self, path: str, pattern: str, min_run: int, max_ratio: float):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.vocabulary = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(f"{_RUN_CLASS}{{{min_run},}}")
        # Every hex and access span lies in a run of this length.
        self.long = re.compile(f"{_RUN_CLASS}{{{min(min_run, 20)},}}")
        self.max_ratio = max_ratio

    @classmethod
    def of(cls, *key) -> Scanner:
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def ratio(self, run: str) -> float:
        """Characters per token."""
        pieces = [run[i : i + _PIECE] for i in range(0, len(run), _PIECE)]
        return len(run) / sum(len(self.vocabulary.encode_ordinary(piece)) for piece in pieces)

    def random(self, run: str) -> bool:
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        return mixed and not known_digest(run) and not identifier(run) and self.ratio(run) < self.max_ratio

    def spans(self, text: str, assigned: bool, long_runs: bool) -> list[tuple[int, int, int]]:
        """``(start, place of the kind, end)``; the flags say what the text can hold."""
        found = []
        if assigned:
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= _LEAST["assign"]]
        runs = list(self.long.finditer(text)) if long_runs else []
        for run in runs:
            whole, at = run[0], run.start()
            found += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(whole) if len(m[0]) >= _LEAST["access"]]
            found += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(whole)]
        found.sort()
        starts = np.array([s for s, _, _ in found], np.int64)
        # Spans of different kinds may overlap; the furthest end so far tells what touches a run.
        ends = np.maximum.accumulate(np.array([e for _, _, e in found], np.int64)) if found else starts
        added = []
        for run in runs:
            before = int(np.searchsorted(starts, run.end()))
            free = not before or ends[before - 1] <= run.start()
            if free and self.run.fullmatch(run[0]) and self.random(run[0]):
                added.append((run.start(), 3, run.end()))
        return sorted(found + added)


def secret_spans(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    min_run: int = MIN_RUN,
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """``doc_id, spans`` for every row, spans as ``array<struct<kind, start, stop>>``.

    ``vocabulary`` is the path of a tiktoken rank file on every worker and
    ``pattern`` the split pattern that goes with it.  Starts and stops count code
    points of the whole text, the stop is exclusive, and spans are ordered by
    start, then kind.  Null and empty texts have no spans, null ids are kept,
    repeated rows give repeated rows, further columns are ignored, and an empty
    table gives no rows.  A run longer than 512 characters is counted in pieces
    of 512.  No row leaves its task, so nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(vocabulary, pattern, min_run, max_ratio)
        long_filter = f"{_RUN_CLASS}{{{min(min_run, 20)},}}"
        for batch in batches:
            texts = batch.column("text")
            assigned = pc.match_substring_regex(texts, _ASSIGN_FILTER).to_numpy(zero_copy_only=False)
            runs = pc.match_substring_regex(texts, long_filter).to_numpy(zero_copy_only=False)
            offsets, rows = np.zeros(len(texts) + 1, np.int32), []
            for k in np.flatnonzero(assigned | runs).tolist():
                found = scanner.spans(texts[k].as_py(), bool(assigned[k]), bool(runs[k]))
                offsets[k + 1] = len(found)
                rows += found
            fields = [
                pa.array([KINDS[kind] for _, kind, _ in rows], pa.string()),
                pa.array([start for start, _, _ in rows], pa.int64()),
                pa.array([stop for _, _, stop in rows], pa.int64()),
            ]
            entries = pa.StructArray.from_arrays(fields, ["kind", "start", "stop"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), entries)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,stop:bigint>>")


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_report(found: DataFrame) -> DataFrame:
    """Counts of the known forms, the digest of their spans and the list of all spans.

    ``found`` is the result of ``secret_spans``.
    """
    spans = F.col("spans")

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        of_kind("assign"),
        of_kind("access"),
        of_kind("hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def masked_texts(docs: DataFrame, vocabulary: str, pattern: str, mask: str = "*") -> DataFrame:
    """``docs`` with every character of a span replaced by ``mask``; nulls stay null.

    Columns of ``docs`` are kept.  Overlapping spans are masked once.
    """

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner.of(vocabulary, pattern, MIN_RUN, MAX_RATIO)
        for batch in batches:
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            for k, text in enumerate(texts):
                parts, done = [], 0
                for start, _, stop in scanner.spans(text, True, True) if text else []:
                    start = max(start, done)
                    if stop > start:
                        parts += [text[done:start], mask * (stop - start)]
                        done = stop
                if parts:
                    texts[k] = "".join([*parts, text[done:]])
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(cover, docs.schema)
