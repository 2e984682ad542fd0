"""Quality rules by the frequency of lines across documents.

Lines are lower-cased, their blanks collapsed, and hashed.  Per host (the
column ``source``) the distinct documents of each line are counted; lines above
the limit are boilerplate and are removed.  A document that loses more than a
share of its words is depleted and rejected, as is one that fails the base rules.

Near copies count as one document, as everywhere with five words and a
similarity of 0.8: they are left to the deduplication, and a much-copied good
document stays.  This is asked of the texts that the plain count would deplete.
Where eight ninths of a text's windows of five words are on further such texts, its
own share is so small that two texts of this kind are near copies; it is then
named by its smallest window on at most as many texts as the limit, if these make
a ninth, or else by its smallest window on more.  Copies of one text agree on that
name but for the few that were edited just there.  All other texts are named by
themselves, and the distinct names of a line's texts are counted.

Counts are pre-aggregated before each shuffle, and only hashes travel, never
texts.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions.let import bind
from trailframe.llm.common import BLANK_RUN, MAX_HOT_KEYS, hot_join, text_of, without_blanks, without_listed, words_of
from trailframe.operators.skew import marked_by_bitmap
from trailframe.session import write_through

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_LIMIT = 25
MAX_LOST_PERCENT = 70
SHINGLE = 5
# Two texts that share eight ninths of their windows with each other have a similarity of 0.8.
MIN_SHARED_NINTHS = 8
# Up to so many repeated windows a linear search is cheaper than a sort; the result is the same.
FEW_WINDOWS = 64


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes: in a text of 20,000 words two
    different windows agree with a probability of one in a hundred billion.
    """

    def counted(positions: Column) -> Column:
        steps = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(positions) - 1, F.lit(1))),
            lambda i: F.least(F.lit(3), F.coalesce(F.get(positions, i) - F.get(positions, i - 1), F.lit(0))),
        )
        return F.when(F.size(positions) == 0, 0).otherwise(F.lit(3) + F.aggregate(steps, F.lit(0), lambda a, b: a + b))

    def by_search(windows: Column, repeated: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(repeated, F.get(windows, i)))
        return bind(at, counted)

    def by_sort(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def found(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(p, a)["w"] == F.get(p, b)["w"], F.lit(False))
            hits = F.filter(p, lambda x, k: same(k, k + 1) | (F.when(k > 0, same(k, k - 1)).otherwise(False)))
            return bind(F.sort_array(F.transform(hits, lambda x: x["i"])), counted)

        return bind(pairs, found)

    def of_windows(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda w, i: F.when(i > 0, w == F.get(s, i - 1)).otherwise(False))
            return bind(
                F.array_distinct(twice),
                lambda r: F.when(F.size(r) == 0, 0)
                .when(F.size(r) <= FEW_WINDOWS, by_search(windows, r))
                .otherwise(by_sort(windows)),
            )

        return bind(F.sort_array(windows), of_sorted)

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.when(F.size(w) < 3, 0).otherwise(bind(windows, of_windows))

    return bind(words, of_words).cast("bigint")


def normal_line(line: Column) -> Column:
    """Lower-cased, blanks collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, BLANK_RUN, " ")))


def line_facts(text: Column) -> Column:
    """Lines with a word: ``h`` (hash) and ``words``."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), normal_line), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")
        ),
    )


def base_facts(docs: DataFrame, *more: Column) -> DataFrame:
    """Base counts and line hashes of every row, without its text, and the columns ``more``."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(text)
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.md5(text).alias("md5"),
        bind(
            words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeat_words(w).alias("n_repeat_words"))
        ).alias("_w"),
        F.length(without_blanks(text)).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        line_facts(text).alias("lines"),
        *more,
    ).select(
        "doc_id", "source", "md5", "_w.*", "word_chars", "n_symbols", "n_dup_lines", "lines",
        *[F.col(c) for c in ([_ROW] if more else [])],
    )


_ROW = "row"


def line_rows(rows: DataFrame) -> DataFrame:
    """``source, md5, h, words``: the lines of each distinct text of a host, ``words`` summed; a written table."""
    exploded = rows.select("source", "md5", F.posexplode("lines").alias("pos", "line"))
    each = exploded.select("source", "md5", "pos", "line.*").distinct()
    return write_through(each.groupBy("source", "md5", "h").agg(F.sum("words").alias("words")), "lines")


def text_names(docs: DataFrame, depleted: DataFrame, line_limit: int) -> DataFrame:
    """``source, md5, name`` of the ``depleted`` texts that are near copies of others of them; a written table."""
    text = text_of()
    rows = docs.select(F.col("source").cast("string").alias("source"), F.md5(text).alias("md5"), text.alias("text"))
    listed = depleted.select(F.col("source").alias("_source"), F.col("md5").alias("_md5"))
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("md5") == F.col("_md5"))
    own, other = ([F.col(c) for c in cs] for cs in (("source", "md5"), ("_source", "_md5")))
    # One row per text before the join, so that copies neither travel nor meet in a task.
    found = marked_by_bitmap(rows, listed, own, other, "_maybe").where("_maybe")
    texts = found.groupBy("source", "md5").agg(F.any_value("text").alias("text")).join(listed, match, "left_semi")
    windows = bind(
        words_of(F.lower("text")),
        lambda w: F.when(
            F.size(w) >= SHINGLE,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))),
                lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")), 1, 15), 16, 10).cast("bigint"),
            ),
        ),
    )
    windows = write_through(texts.select("source", "md5", F.explode(F.array_distinct(windows)).alias("w")), "windows")
    counts = write_through(windows.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")), "window-counts")
    counts = counts.withColumn("texts", F.col("n"))
    counted = hot_join(windows, counts, ["source", "w"], "n", windows.count())
    rare = F.when(F.col("texts").between(2, line_limit), F.col("w"))
    common = F.when((F.col("texts") > line_limit) & (F.col("texts") > 1), F.col("w"))
    sums = counted.groupBy("source", "md5").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count(F.when(F.col("texts") > 1, 1)).alias("shared"),
        F.count(rare).alias("rare"),
        F.min(rare).alias("rare_name"),
        F.min(common).alias("common_name"),
    )
    near = sums.where(9 * F.col("shared") >= MIN_SHARED_NINTHS * F.col("windows"))
    by_rare = 9 * F.col("rare") >= (9 - MIN_SHARED_NINTHS) * F.col("windows")
    name = F.when(by_rare, F.col("rare_name")).otherwise(F.col("common_name"))
    return write_through(near.select("source", "md5", name.cast("string").alias("name")), "names")


def frequent_lines(docs: DataFrame, rows: DataFrame, lines: DataFrame, line_limit: int, total: int) -> tuple[DataFrame, DataFrame]:
    """``source, h, n`` with ``frequent`` of the lines on too many texts, and these lines' rows of ``lines``.

    ``frequent`` says whether they are on too many documents.  Both are written tables.
    """
    counts = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n"))
    # Hot lines that are not on many texts are named as well, so that they are not shuffled.
    counts = counts.withColumn("many", F.col("n") > line_limit)
    counts = write_through(counts.where(F.col("many") | (F.col("n") > total // MAX_HOT_KEYS)), "texts-of-lines")
    hits = write_through(hot_join(lines, counts, ["source", "h"], "n", total).where("many").drop("many"), "hits")
    lost = hits.groupBy("source", "md5").agg(F.sum("words").alias("lost"))
    sizes = rows.groupBy(F.col("source").alias("_source"), F.col("md5").alias("_md5")).agg(F.max("n_words").alias("n_words"))
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("md5") == F.col("_md5"))
    depleted = lost.join(sizes, match).where(_depleted(F.col("lost"))).select("source", "md5")
    names = text_names(docs, write_through(depleted, "depleted-by-texts"), line_limit)
    names = names.select(F.col("source").alias("_source"), F.col("md5").alias("_md5"), "name")
    named = hits.join(names, match, "left").select("source", "h", F.coalesce("name", "md5").alias("name"))
    documents = named.groupBy("source", "h", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("source", "h").agg(
        F.sum("n").alias("n"), (F.count(F.lit(1)) > line_limit).alias("frequent")
    )
    return write_through(documents, "frequent"), hits


def lost_words(docs: DataFrame, rows: DataFrame, total: int, line_limit: int) -> DataFrame:
    """``source, md5, lost``: words of each distinct text in frequent lines.

    ``total`` bounds the number of lines.
    """
    lines = line_rows(rows)
    marked, hits = frequent_lines(docs, rows, lines, line_limit, total)
    hit = hot_join(hits, marked, ["source", "h"], "n", hits.count()).where("frequent")
    return hit.groupBy("source", "md5").agg(F.sum("words").alias("lost"))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _depleted(lost: Column) -> Column:
    return 100 * lost > MAX_LOST_PERCENT * F.col("n_words")


def _judged(docs: DataFrame, rows: DataFrame, line_limit: int) -> DataFrame:
    """The written ``rows`` of ``base_facts`` with ``base_failed``, ``kept`` and ``lost_words``."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lines") + 1).alias("lines")).first()
    lost = lost_words(docs, rows, found["lines"] or 0, line_limit)
    lost = lost.select(F.col("source").alias("_source"), F.col("md5").alias("_md5"), "lost")
    # A row for every text, also for those that lose nothing.
    texts = rows.groupBy("source", "md5").agg(F.count(F.lit(1)).alias("copies"))
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("md5") == F.col("_md5"))
    texts = texts.join(lost, match, "left")
    texts = texts.select("source", "md5", "copies", F.coalesce("lost", F.lit(0)).alias("lost_words"))
    joined = hot_join(rows.drop("lines"), write_through(texts, "texts"), ["source", "md5"], "copies", found["n"])
    return joined.withColumns({"base_failed": _failed(), "kept": ~_failed() & ~_depleted(F.col("lost_words"))})


def quality(docs: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """One row per document with its base counts and the verdict ``kept``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_words``.  A null text has no words; a null source
    is a host of its own.  Repeated rows get equal verdicts.  Further columns
    are ignored; an empty table gives no rows.
    """
    judged = _judged(docs, write_through(base_facts(docs), "facts"), line_limit)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"
    )


def kept_documents(docs: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """The documents that pass, with all their columns and whole texts.

    Documents that pass the base rules are written once with their line hashes,
    so that the counts are not made again; then the few depleted texts go.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW)
    facts = write_through(base_facts(docs, row).withColumn(_ROW, F.when(~_failed(), F.col(_ROW))), "facts")
    judged = _judged(docs, facts.drop(_ROW), line_limit)
    depleted = judged.where(~F.col("base_failed") & ~F.col("kept")).select("source", "md5").distinct()
    depleted = write_through(depleted.select(F.col("source").alias("_source"), F.col("md5").alias("_md5")), "depleted")
    match = F.col("source").eqNullSafe(F.col("_source")) & (F.col("md5") == F.col("_md5"))
    own, listed = ([F.col(c) for c in cs] for cs in (("source", "md5"), ("_source", "_md5")))
    passed = without_listed(facts.where(F.col(_ROW).isNotNull()), depleted, match, own, listed)
    return passed.select(f"{_ROW}.*")


def without_frequent_lines(docs: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """``doc_id, source, text`` with the lines above the limit removed from the texts.

    For users who want cleaned texts; the verdicts do not depend on it.
    """
    facts = write_through(base_facts(docs), "facts")
    rows = line_rows(facts)
    marked, _ = frequent_lines(docs, facts, rows, line_limit, rows.count())
    frequent = marked.where("frequent").select("source", "h")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text_of().alias("text"),
    )
    split = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = numbered.select("row", "doc_id", "source", split)
    lines = write_through(lines.withColumn("h", F.xxhash64(normal_line(F.col("line")))), "split")
    counts = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).join(
        frequent.select(F.col("source").alias("_s"), F.col("h").alias("_h")),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("h") == F.col("_h")),
        "left",
    )
    flags = write_through(counts.select("source", "h", "n", F.col("_h").alias("gone")), "flags")
    marked = hot_join(lines, flags, ["source", "h"], "n", lines.count())
    keep = F.when(F.col("gone").isNull(), F.struct("pos", "line"))
    joined = marked.groupBy("row", "doc_id", "source").agg(F.sort_array(F.collect_list(keep)).alias("kept"))
    return joined.select("doc_id", "source", F.concat_ws("\n", F.col("kept.line")).alias("text"))
