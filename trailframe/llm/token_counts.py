"""Token counts by rank-synchronous merging of arrays.

The model (a score per piece, best score first, ties from the left, bytes for
unknown characters) is read from its file by the sentencepiece library.  No
piece crosses from a visible character into a blank mark, so texts are cut
there into pre-tokens; long ones are cut as well between characters that no
piece holds next to each other.  Distinct pre-tokens are counted once per batch
and short ones kept in a bounded table.  New pre-tokens lie in one ragged array of symbol numbers.
In every round each sequence finds its lowest-ranked pair of neighbours, all
sequences merge theirs at once, and finished sequences leave.  What survives is
counted: a known symbol is one token, an unknown character one per byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import text_of

LIMIT = 4096
KEPT_WORDS = 500_000
# Longer pre-tokens are cut where they can be, and not kept.
LONG_WORD = 64
_BATCH_CHARS = 1 << 21
MARK = "▁"
_NONE = np.int64(1 << 60)
_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class MergeCounter:
    """Counts tokens with one model; kept per worker process."""

    _made: dict[str, MergeCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        names = {
            sp.id_to_piece(i): sp.get_score(i)
            for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        }
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece has a blank mark inside: texts cannot be cut there")
        neighbours = {p[i : i + 2] for p in names for i in range(len(p) - 1)}
        # Characters that occur in pieces only as parts are symbols, but no tokens.
        letters = sorted({c for p in names for c in p} - names.keys())
        symbols = [*names, *letters]
        self.number = {s: k for k, s in enumerate(symbols)}
        self.known = len(names)
        ranks = {score: k for k, score in enumerate(sorted(set(names.values()), reverse=True))}
        self.width = len(symbols) + 1
        self.joins = np.array(sorted(self.number[a] * self.width + self.number[b] for a, b in neighbours), np.int64)
        pairs = [
            (self.number[p[:i]] * self.width + self.number[p[i:]], ranks[score], self.number[p])
            for p, score in names.items()
            for i in range(1, len(p))
            if p[:i] in self.number and p[i:] in self.number
        ]
        pairs.sort()
        self.pairs, self.ranks, self.results = (np.array([x[k] for x in pairs], np.int64) for k in range(3))
        shared = np.zeros(len(ranks), np.int64)
        np.add.at(shared, [ranks[s] for s in names.values()], 1)
        # Ranks that several pieces share: their pairs merge one at a time, from the left.
        self.tied = shared > 1
        self.bytes = np.array([1 if k < self.known else len(s.encode()) for k, s in enumerate(symbols)], np.int64)
        # Symbol number per code point; unknown characters are minus their number of bytes.
        points = np.arange(0x110000)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        self.of_point = -widths
        for symbol, k in self.number.items():
            if len(symbol) == 1:
                self.of_point[ord(symbol)] = k
        self.seen: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> MergeCounter:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair of symbols; unknown symbols are negative."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.results[at], -1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = self.of_point[points]
        total = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        rank, result = self._pairs_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(lowest < _NONE, length)
            done = ~live
            tokens = np.where(symbols[done] >= 0, self.bytes[symbols[done]], -symbols[done])
            total += np.bincount(owner[done], tokens, len(words)).astype(np.int64)
            symbols, owner, rank, result = symbols[live], owner[live], rank[live], result[live]
            lowest, length = lowest[lowest < _NONE], length[lowest < _NONE]
            symbols, owner, rank, result = self._merge(symbols, owner, rank, result, lowest, length)
        return total

    def _pairs_at(self, symbols, owner, at):
        """Rank and result of the pairs that begin at the places ``at``; none at the end of a sequence."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, result = self._ranks(symbols[at], symbols[after])
        inner = (after > at) & (owner[at] == owner[after])
        return np.where(inner, rank, _NONE), result

    def _merge(self, symbols, owner, rank, result, lowest, length):
        """One round: every sequence merges its lowest-ranked pair.

        All places of the pair merge at once, unless pieces share the rank or
        a merge makes a pair that ranks as low; then only the leftmost does.
        """
        same = rank == np.repeat(lowest, length)
        # Overlapping places (a run of one symbol) merge alternately from the left.
        position = np.flatnonzero(same)
        runs = np.flatnonzero(same & ~np.concatenate(([False], same[:-1])))
        begin = runs[np.searchsorted(runs, position, "right") - 1]
        chosen = position[(position - begin) % 2 == 0]
        sequence = np.repeat(np.arange(len(length)), length)[chosen]
        first = np.concatenate((np.ones(min(1, len(chosen)), bool), sequence[1:] != sequence[:-1]))
        merged = self._apply(symbols, owner, rank, result, chosen)
        if not first.all():
            starts = np.flatnonzero(np.concatenate(([True], merged[1][1:] != merged[1][:-1])))
            risky = self.tied[lowest] | (np.minimum.reduceat(merged[2], starts) <= lowest)
            if risky.any():
                merged = self._apply(symbols, owner, rank, result, chosen[first | ~risky[sequence]])
        return merged

    def _apply(self, symbols, owner, rank, result, chosen):
        """The sequences after the merges at ``chosen``; only pairs next to a merge are looked up again."""
        out = symbols.copy()
        out[chosen] = result[chosen]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        new_at = chosen - np.arange(len(chosen))
        out, owner, rank, result = out[keep], owner[keep], rank[keep], result[keep]
        touched = np.unique(np.concatenate((new_at, np.maximum(new_at - 1, 0))))
        rank[touched], result[touched] = self._pairs_at(out, owner, touched)
        return out, owner, rank, result

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.seen) > KEPT_WORDS:
            self.seen = {}
        parts = [self.parts(self.normal(t)) for t in texts]
        new = list(set().union(*parts).difference(self.seen))
        if not new:
            return [sum(map(self.seen.__getitem__, p)) for p in parts]
        counted = dict(zip(new, self.count(new).tolist()))
        self.seen.update((w, n) for w, n in counted.items() if len(w) <= LONG_WORD)
        long = {w: n for w, n in counted.items() if len(w) > LONG_WORD}
        return [sum(long[w] if len(w) > LONG_WORD else self.seen[w] for w in p) for p in parts]

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        words = _PARTS.findall(text)
        if max(map(len, words), default=0) <= LONG_WORD:
            return words
        return [part for word in words for part in (self._cut(word) if len(word) > LONG_WORD else (word,))]

    def _cut(self, word: str) -> list[str]:
        """The word between characters that no piece holds next to each other, so that no merge crosses."""
        symbols = self.of_point[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")]
        key = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] * self.width + symbols[1:], -1)
        at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        edges = np.flatnonzero(self.joins[at] != key) + 1
        return [word[a:b] for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(word)])]

    def normal(self, text: str) -> str:
        """The text as the model sees it, with blank marks."""
        return self.library.normalize(text)


def _counts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter.of(model)
        for batch in batches:
            found: list[int] = []
            held: list[str] = []
            size = 0
            for value in batch.column("text"):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= _BATCH_CHARS:
                    found += counter.texts(held)
                    held, size = [], 0
            found += counter.texts(held)
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty and has no tokens.  Repeated rows are counted
    alike; a null ``doc_id`` stays null.  Further columns are ignored; an empty
    table gives no rows.  There is no shuffle.
    """
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")
    )
    counted = rows.mapInArrow(_counts(model), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
