"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1.  The vectors of three letters in a
row are permuted by their place (rotated by two, one and no places) and bound
(multiplied) into the vector of the 3-gram; the 3-grams of a text are bundled
(added).  The prototype of a language is the bundle of all its labelled texts.
A document gets the language whose prototype has the largest cosine with it.

Learning uses every labelled row.  Tasks bundle their rows, Spark adds one
vector per language and task, and the prototypes, one per language, are sent to
the tasks that predict.  Sums are whole numbers, so reruns agree exactly.  Texts of
any length are cut into pieces that share two letters, and the 3-grams of a batch
of pieces are bundled a bounded number of kinds at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.session import write_through

DIMENSIONS = 512
SEED = 17
#: Labels are names of languages; prototypes of more are refused, as they go through the driver.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
_BATCH_CHARS = 1 << 19
_SLICE_KINDS = 16_000
_KEPT_LETTERS = 20_000
_GAP = 0  # stands for any run of other characters


class Profiles:
    """Bundles texts; kept per worker process."""

    _made: dict[int, Profiles] = {}

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        points = np.arange(0x110000)
        self.letter = np.zeros(len(points), bool)
        self.letter[[k for k in range(0x110000) if chr(k).isalpha()]] = True
        self.vectors: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, dimensions: int) -> Profiles:
        if dimensions not in cls._made:
            cls._made[dimensions] = cls(dimensions)
        return cls._made[dimensions]

    def vector(self, point: int) -> np.ndarray:
        if point not in self.vectors:
            if len(self.vectors) > _KEPT_LETTERS:
                self.vectors.clear()
            draws = np.random.default_rng([SEED, point]).integers(0, 2, self.dimensions)
            self.vectors[point] = (2 * draws - 1).astype(np.int8)
        return self.vectors[point]

    def _numbered(self, pieces: list[str], row: np.ndarray):
        """Letters of each piece; the row and the kind of every 3-gram; the kinds and the letters' vectors."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(pieces)), sizes)
        is_letter = self.letter[points]
        letters = np.bincount(owner[is_letter], minlength=len(pieces))
        # One gap for each run of other characters, also at both ends.
        keep = is_letter | np.concatenate(([True], is_letter[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1]))
        points, owner = np.where(is_letter, points, _GAP)[keep], owner[keep]
        present = np.zeros(0x110000, bool)
        present[points] = True
        alphabet = np.flatnonzero(present)
        number = np.zeros(0x110000, np.int64)
        number[alphabet] = np.arange(len(alphabet))
        small, width = number[points], len(alphabet)
        gram = (small[:-2] * width + small[1:-1]) * width + small[2:]
        inside = owner[:-2] == owner[2:]
        gram, whose = gram[inside], row[owner[:-2][inside]]
        if width**3 <= 1 << 22:
            seen = np.zeros(width**3, bool)
            seen[gram] = True
            kinds = np.flatnonzero(seen)
            place = np.zeros(width**3, np.int64)
            place[kinds] = np.arange(len(kinds))
            at = place[gram]
        else:
            kinds, at = np.unique(gram, return_inverse=True)
        return letters, whose, at, kinds, np.stack([self.vector(int(p)) for p in alphabet])

    @staticmethod
    def _bound(kinds: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Vectors of the 3-grams ``kinds``."""
        width = len(table)
        a, b, c = table[kinds // width**2], table[kinds // width % width], table[kinds % width]
        return (np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c).astype(np.float32)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of letters per text, counts (texts x 3-grams) and the 3-grams' vectors, of a few short texts."""
        pieces = ["\0" + t.lower() + "\0" for t in texts]
        letters, whose, at, kinds, table = self._numbered(pieces, np.arange(len(texts)))
        counts = np.bincount(whose * len(kinds) + at, minlength=len(texts) * len(kinds))
        return letters, counts.reshape(len(texts), len(kinds)), self._bound(kinds, table)

    def bundles(self, pieces: list[str], row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each piece, and the bundles of ``n_rows`` rows; a piece belongs to the row ``row``."""
        letters, whose, at, kinds, table = self._numbered(pieces, row)
        sums = np.zeros((n_rows, self.dimensions), np.float32)
        for low in range(0, len(kinds), _SLICE_KINDS):
            part = kinds[low : low + _SLICE_KINDS]
            mine = (at >= low) & (at < low + len(part)) if len(part) < len(kinds) else slice(None)
            counts = np.bincount(whose[mine] * len(part) + at[mine] - low, minlength=n_rows * len(part))
            # Whole numbers below 2**24, as a batch has fewer 3-grams: exact.
            sums += counts.reshape(n_rows, len(part)).astype(np.float32) @ self._bound(part, table)
        return letters, sums


def _last_two(piece: str) -> str:
    """The last two letters or gaps."""
    found = ""
    for char in reversed(piece):
        symbol = char if char.isalpha() else "\0"
        if symbol != "\0" or found[:1] != "\0":
            found = symbol + found
            if len(found) == 2:
                break
    return found


def _pieces(text: str) -> Iterator[str]:
    """The lower-cased text between gaps, in pieces; each begins with the last two letters of the one before."""
    lowered = "\0" + text.lower() + "\0"
    if len(lowered) <= _BATCH_CHARS:
        yield lowered
        return
    before = ""
    for low in range(0, len(lowered), _BATCH_CHARS):
        piece = before + lowered[low : low + _BATCH_CHARS]
        before = _last_two(piece)
        yield piece


def _batched(texts: Iterator[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces, and the number of the text that each belongs to."""
    held: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            held.append(piece)
            owners.append(k)
            size += len(piece)
            # The count matrix is bounded by the number of pieces too.
            if size >= _BATCH_CHARS or len(held) >= 256:
                yield held, np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield held, np.array(owners)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of all labels of ``docs(text, lang)``."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles.of(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for pieces, owners in _batched(t.as_py() for t in batch.column("text")):
                present, row = np.unique(langs[owners].astype(str), return_inverse=True)
                _, bundled = profiles.bundles(pieces, row, len(present))
                for lang, one in zip(present.tolist(), bundled.astype(np.int64)):
                    sums[lang] = sums.get(lang, 0) + one
        columns = [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bundle"])

    parts = docs.mapInArrow(bundle, "lang string, bundle array<bigint>")
    summed = parts.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    lists = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("p"))
    prototypes = write_through(lists.select("lang", F.col("p.x").alias("bundle")), "prototypes")
    n = prototypes.count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} labels are too many for languages")
    return {r["lang"]: np.array(r["bundle"], np.float64) for r in prototypes.orderBy("lang").collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``text`` is replaced by them."""
    names = list(prototypes)
    unit = np.stack([p / max(np.linalg.norm(p), 1e-12) for p in prototypes.values()]) if names else None
    others = [f for f in docs.schema.fields if f.name != "text"]

    def decide(texts: pa.Array) -> tuple[list[str], list[float]]:
        profiles = Profiles.of(unit.shape[1])
        letters, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), unit.shape[1]))
        for pieces, owners in _batched(t.as_py() or "" for t in texts):
            own, row = np.unique(owners, return_inverse=True)
            found, bundled = profiles.bundles(pieces, row, len(own))
            np.add.at(letters, owners, found)
            sums[own] += bundled
        bundles = sums.astype(np.float32)
        length = np.maximum(np.linalg.norm(bundles, axis=1), 1e-12)
        cosine = (bundles @ unit.T.astype(np.float32)) / length[:, None]
        best = cosine.argmax(axis=1)
        value = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        return [names[k] if n else UNKNOWN for k, n in zip(best, letters)], [float(v) if n else 0.0 for v, n in zip(value, letters)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if unit is None:
                chosen, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            else:
                chosen, scores = decide(batch.column("text"))
            columns = [batch.column(f.name) for f in others] + [pa.array(chosen, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in others], "lang_pred", "score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["lang_pred string", "score double"])
    return docs.mapInArrow(compare, schema)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if no row has a label.  Equal cosines go to the first label by code
    point.  Repeated rows are judged alike.  Further columns are ignored; an
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    marked = rows.withColumn("held_out", held_out(F.col("doc_id")))
    labelled = marked.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    prototypes = learn(labelled.select("text", "lang"), dimensions)
    return predict(marked.select("doc_id", "held_out", "text"), prototypes)
