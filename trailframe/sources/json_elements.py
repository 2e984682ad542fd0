"""Elements of large JSON documents, read by many tasks.

A document is read as text that is cut behind every closing brace, so Spark splits
the file like any text file, and no cut lies inside a character.  A fragment alone
does not tell whether it begins inside a string or how deep it is nested.  Both
follow from all fragments before it: the number of quotes, then the brackets
outside of strings, are counted per fragment and added up over the file.  These
sums are made per split and over splits, so no task sees a whole file.

A list is a long row of objects; each object behind the first is an *element*.  What
is left of a document without its elements is again a document, the *rest*, with the
same fields and a list of one object.  A document whose list holds other things than
objects, or that is no sound JSON, has no elements: its rest is all of it, and the reader
sees the document as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.operators.skew import salted_join
from trailframe.session import write_through

_BRACE = "}"
#: A table of so many documents is broadcast (a few hundred bytes each), a larger one is joined by shuffling.
MAX_BROADCAST = 10_000

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _depth(outside: Column) -> Column:
    """Nesting gained by a text without strings; closing braces are the cuts themselves."""
    return _count(outside, "{") + _count(outside, "[") - _count(outside, "]")


def _fragments(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Texts between closing braces, with their quotes and their nesting for either beginning."""
    read = spark.read.option("lineSep", _BRACE).text(paths if isinstance(paths, str) else list(paths))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
        plain.alias("_plain"),
    ).select(
        "file",
        "block",
        "file_size",
        "at",
        "value",
        F.octet_length("value").alias("size"),
        _count(F.col("_plain"), '"').alias("quotes"),
        _depth(F.regexp_replace("_plain", strings, "")).alias("from_outside"),
        _depth(F.regexp_replace(F.regexp_replace("_plain", r'\A[^"]*("|\z)', ""), strings, "")).alias("from_inside"),
    )


def _add_up(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all earlier fragments of the file."""
    valued = rows.withColumn("_v", value.cast("bigint"))
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumn("_local", F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
    # One row per split of a file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = valued.groupBy("file", "block").agg(F.sum("_v").alias("_s"))
    carried = sums.select("file", "block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_carry"))
    return local.join(carried, ["file", "block"]).withColumn(name, F.col("_local") + F.col("_carry")).drop("_v", "_local", "_carry")


def _open_list(text: str, depth: int, level: int) -> str | None:
    """Key of the list whose objects lie at ``level`` and that is open behind ``text``; ``""`` for a document that is a list."""
    keys: list[str | None] = [None] * max(depth, 0)
    last, key = None, None
    for m in _TOKENS.finditer(text):
        token = m[0]
        if token[0] == '"':
            last = token[1:-1]
        elif token in "{[":
            key = ("" if depth == 0 else last) if token == "[" else None
            keys, depth = [*keys[:depth], key], depth + 1
        else:
            depth -= 1
    return keys[level - 1] if depth == level and len(keys) >= level else None


def with_documents(rows: DataFrame, documents: DataFrame, total: int) -> DataFrame:
    """Columns of a row's document; one document may hold all rows."""
    if documents.count() <= MAX_BROADCAST:
        return rows.join(F.broadcast(documents), "file")
    return salted_join(rows, documents, ["file"], ["part"], total)


def json_elements(
    spark: SparkSession, paths: str | Sequence[str], level: int, list_key: str, valid: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame]:
    """``rest(file, text)`` and ``elements(file, idx, text)`` of plain JSON files, one document each.

    ``level`` is the nesting of the list's objects: 1 if the document is the list,
    2 if the list is its field ``list_key``.  ``idx`` is the place in the list;
    the object at place 0 is part of the rest.  ``valid`` says of a text whether it
    is a readable element.  Compressed files cannot be cut; read them whole.
    """
    fragments = write_through(_fragments(spark, paths), "fragments")
    index = fragments.drop("value")
    index = _add_up(index, F.col("quotes"), "_quotes")
    inside = F.pmod("_quotes", F.lit(2)) == 1
    ends_outside = F.pmod(F.col("_quotes") + F.col("quotes"), F.lit(2)) == 0
    # The last fragment of a file may have no brace behind it: bytes and braces then are one more than the file has.
    whole = index.groupBy("file").agg((F.sum("size") + F.count(F.lit(1)) - F.max("file_size")).alias("_over"), F.max(F.struct("block", "at")).alias("_last"))
    index = with_documents(index.withColumn("part", F.col("at")), whole, index.count()).drop("part")
    braced = (F.col("_over") == 0) | (F.struct("block", "at") != F.col("_last"))
    closes = (ends_outside & braced).cast("bigint")
    index = index.withColumns({"_braced": braced, "_gain": F.when(inside, F.col("from_inside")).otherwise(F.col("from_outside")) - closes, "_closes": closes})
    index = _add_up(index, F.col("_gain"), "depth")
    cut = (F.col("_closes") == 1) & (F.col("depth") + F.col("_gain") <= level)
    index = _add_up(index.withColumn("_cut", cut), cut, "part")
    placed = fragments.select("at", "value").join(index.select("file", "block", "at", "_braced", "depth", "_cut", "part"), "at")
    piece = F.struct("block", "at", F.concat("value", F.when(F.col("_braced"), _BRACE).otherwise("")).alias("text"))
    parts = placed.groupBy("file", "part").agg(
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.min_by("depth", F.struct("block", "at")).alias("depth"),
        F.max("_cut").alias("cut"),
    )
    text = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    parts = parts.select("file", "part", "depth", "cut", text.alias("text"))
    follows = (F.col("depth") == level) & F.col("cut") & F.col("text").rlike(r"\A\s*,\s*\{")
    parts = write_through(parts.withColumn("follows", follows), "parts")

    @F.pandas_udf("string")
    def open_list(texts: pd.Series, depths: pd.Series) -> pd.Series:
        return pd.Series([_open_list(t, int(d), level) for t, d in zip(texts, depths)], dtype=object)

    # Parts that are no elements are few, unless a document is irregular.
    others = parts.where("not follows").select("file", "part", "depth", "text", open_list("text", "depth").alias("list"))
    ours = F.col("list").eqNullSafe(F.lit(list_key))
    goes_on = (F.col("depth") == level) & ~F.col("text").rlike(r"\A\s*(\]|\z)")
    openers = others.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("part", ours.alias("ours"), goes_on.alias("goes_on")))).alias("openers"),
        F.count_if(ours).alias("lists"),
    )
    # The list goes on with something else than an object.
    mixed = F.transform("openers", lambda o, i: o["goes_on"] & F.coalesce(F.get(F.col("openers"), i - 1)["ours"], F.lit(False)))
    openers = openers.select("file", "openers", (F.exists(mixed, lambda m: m) | (F.col("lists") > 1)).alias("irregular"))
    element = F.regexp_replace("text", r"\A\s*,\s*", "")
    unsound = parts.where("follows").where(~F.coalesce(valid(element), F.lit(False))).select("file").distinct()
    documents = openers.join(unsound.withColumn("_unsound", F.lit(True)), "file", "left").select(
        "file", "openers", (F.col("irregular") | F.col("_unsound").isNotNull()).alias("irregular")
    )
    documents = write_through(documents, "documents")
    known = with_documents(parts, documents, parts.count())
    opener = F.element_at(F.filter("openers", lambda o: o["part"] < F.col("part")), -1)
    elements = (
        known.where("follows and not irregular")
        .withColumn("_opener", opener)
        .where("_opener.ours")
        .select("file", (F.col("part") - F.col("_opener.part")).alias("idx"), element.alias("text"))
    )
    # Other lists keep their first object only; no reader asks for them.
    left = known.where("irregular or not follows").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_t"))
    rest = left.select("file", F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("text"))
    return rest, elements
