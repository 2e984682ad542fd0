"""Token ids of whole texts, by the tokenizers library, with repeated words encoded once.

A byte-level vocabulary splits text before any merge, and a space or a line end
that follows a visible character always begins a new part; a line end between
visible characters is a part of its own.  Texts are cut there; equal cuts have
equal ids, whatever stands around them.  The distinct cuts of a batch are found
by Arrow's dictionary encoding.  New ones are encoded by the library in long
lines, whose ids are taken apart where a token begins with a space or is a line
end, and are kept in a table per worker, bounded in bytes; the ids of the texts are then
gathered with numpy.  Texts with other runs of blanks are cut at spaces only;
texts that hold a special string are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per worker, of some 200 bytes each; longer words count for more.
KEPT_WORDS = 800_000
_WORD_BYTES = 200
_LINE_WORDS = 100
_BATCH_CHARS = 1 << 20
#: Characters that the library gets at once, or one text: it holds some hundred bytes per token until they are read.
_LIBRARY_CHARS = 1 << 16

#: Blanks other than single spaces and line ends between visible characters, for Arrow's expressions.
_ODD = (
    r"[\x{09}\x{0B}-\x{0D}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    r"|[ \n][ \n]|\A[ \n]|[ \n]\z"
)
_CUT = re.compile(r"(?<=\S)(?= )")


class Encoder:
    """Encodes texts with one vocabulary; kept per worker process."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        self.kept_words = kept_words
        # Tasks are the unit of parallelism.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = added
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for piece, k in vocabulary.items() if piece.startswith("Ġ")]] = True
        self.line_end = self._whole(["\n"])[0]
        # Words after a space; words after a line end with it in front, and its id in theirs.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words that were not used lately
        self.word_bytes = 0  # of the words, with their ids
        self.parts: dict[str, bytes] = {}  # cuts of texts with odd blanks
        self.part_bytes = 0

    @classmethod
    def of(cls, path: str, kept_words: int = KEPT_WORDS) -> Encoder:
        key = (path, kept_words)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        while len(out) < len(texts):
            begin = end = len(out)
            size = 0
            while end < len(texts) and (end == begin or size + len(texts[end]) <= _LIBRARY_CHARS):
                size += len(texts[end])
                end += 1
            found = self.tokenizer.encode_batch_fast(texts[begin:end], add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in found]
        return out

    def _apart(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of visible words, each after a space or after a line end."""
        blank = " " if spaced else "\n"
        lines = [blank + blank.join(words[i : i + _LINE_WORDS]) for i in range(0, len(words), _LINE_WORDS)]
        data = b"".join(self._whole(lines))
        ids = np.frombuffer(data, "<u4")
        starts = np.flatnonzero(self.spaced[ids] if spaced else ids == np.frombuffer(self.line_end, "<u4")[0])
        if len(starts) != len(words):
            return self._whole([blank + w for w in words])
        ends = [*(4 * starts[1:]).tolist(), len(data)]
        return [data[a:b] for a, b in zip((4 * starts).tolist(), ends)]

    def _learn(self, words: list[str]) -> None:
        """Encode words, those after a line end with it in front."""
        later = [w for w in words if w[:1] != "\n"]
        first = [w for w in words if w[:1] == "\n"]
        self.words.update(zip(later, self._apart(later, True) if later else []))
        self.words.update(zip(first, self._apart([w[1:] for w in first], False) if first else []))

    def _known(self, names: list[str]) -> list[bytes]:
        """Ids of each word."""
        if self.word_bytes > self.kept_words * _WORD_BYTES // 2:
            # Words used again in time stay; the others go at the next change.
            self.older, self.words, self.word_bytes = self.words, {}, 0
        own = list(map(self.words.get, names))
        missing = [k for k, ids in enumerate(own) if ids is None]
        if missing:
            new = [names[k] for k in missing]
            older = {w: ids for w, ids in zip(new, map(self.older.get, new)) if ids is not None} if self.older else {}
            self.words.update(older)
            self._learn([w for w in new if w not in older] if older else new)
            for k, w in zip(missing, new):
                own[k] = self.words[w]
            self.word_bytes += sum(map(len, new)) + sum(len(own[k]) for k in missing) + len(new) * _WORD_BYTES * 3 // 4
        return own

    def _ordinary(self, texts: pa.Array) -> list[bytes]:
        """Texts with single spaces and line ends between visible characters only."""
        blank, line_end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        marked = pc.binary_join_element_wise(blank, pc.replace_substring(texts, "\n", " \n"), line_end)
        split = pc.split_pattern(marked, " ")
        coded = split.values.dictionary_encode()
        kinds = coded.dictionary
        # Words hold no space, so one joined text is taken apart again at once.
        whole = pa.ListArray.from_arrays([0, len(kinds)], kinds.cast(pa.string()))
        own = self._known(pc.binary_join(whole, " ")[0].as_py().split(" "))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids = np.frombuffer(b"".join(own), "<u4")
        word = coded.indices.to_numpy()
        count = size[word]
        ends = np.cumsum(count)
        place = np.repeat((np.cumsum(size) - size)[word] - (ends - count), count)
        place += np.arange(len(place))
        joined = ids[place]
        bounds = np.concatenate(([0], ends))[split.offsets.to_numpy()].tolist()
        # The line end in front of the first word is not of the text.
        return [joined[a + 1 : b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _with_odd_blanks(self, texts: pa.Array) -> list[bytes]:
        if self.part_bytes > self.kept_words * _WORD_BYTES // 4:
            self.parts, self.part_bytes = {}, 0
        cuts = [_CUT.split(text) for text in texts.to_pylist()]
        new = list({part for cut in cuts for part in cut}.difference(self.parts))
        if new:
            self.parts.update(zip(new, self._whole(new)))
            self.part_bytes += sum(len(part) + len(self.parts[part]) + _WORD_BYTES // 2 for part in new)
        return [b"".join([self.parts[part] for part in cut]) for cut in cuts]

    def _some(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        special = np.zeros(len(texts), bool)
        for content in self.special:
            special |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        full = pc.binary_length(column).to_numpy() > 0
        out: list[bytes] = [b""] * len(texts)
        for which, code in (
            (full & ~special & ~odd, self._ordinary),
            (full & ~special & odd, self._with_odd_blanks),
            (special, lambda some: self._whole(some.to_pylist())),
        ):
            places = np.flatnonzero(which)
            if len(places):
                for k, ids in zip(places.tolist(), code(column.take(pa.array(places)))):
                    out[k] = ids
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= _BATCH_CHARS:
                yield from self._some(held)
                held, size = [], 0
        if held:
            yield from self._some(held)
