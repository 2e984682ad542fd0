"""Mixing sources to target weights by hash-threshold histograms.

Every document draws a 60-bit number from its id and its text.  Per source, words are summed
by the leading bits of that number; the bucket in which the running sum crosses
the budget is the boundary.  Only the documents of boundary buckets are summed
again, by the next bits, until the bits are used up.  What lies below the
threshold is taken; nothing is sorted.  Thresholds are nested: a larger budget
takes a superset.

Sources in code-point order (null last) weigh 3, 1, 2, and so on from the
start.  Together they share 150 % of all words.  A target stops at twice the
size of its source, and the excess is shared anew by weight among the others.
A target above the size of its source takes the whole source once and a second
copy of the documents below the threshold of the remainder.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailframe.llm.common import hot_join, text_of
from trailframe.session import write_through

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
HASH_BITS = 60
STEP_BITS = 12


def draw_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the digest of the id and the text, so that documents without an id draw apart."""
    named = F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("bigint")


def n_words(text: Column) -> Column:
    """Runs of characters other than blanks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``(source, source_size)``.

    The level at which all budgets are used is found in one pass over the
    sources in the order in which they reach their limit, by prefix sums.
    """
    # One row per source; with very many sources still one small row each.
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    index = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (index + 1).cast("int"))
    table = sizes.withColumns({"weight": weight, "limit": F.col("source_size") * most})
    table = table.withColumn("ratio", F.col("limit") / F.col("weight"))
    full = W.orderBy("ratio", F.col("source").isNull(), "source")
    whole = W.partitionBy()
    table = table.withColumns(
        {
            "budget": F.sum("source_size").over(whole) * share,
            "held": F.coalesce(F.sum("limit").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "left_weight": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    # The first source that stays below its limit at this level fixes it for all later ones.
    table = table.withColumn("level", (F.col("budget") - F.col("held")) / F.col("left_weight"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("l")))).over(whole)
    table = table.withColumn("level", -first["l"])
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return table.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, budgets: DataFrame, total: int) -> DataFrame:
    """``skey, cut``: documents with a number below ``cut`` fill the budget.

    ``docs(skey, h, size)`` is a written table of ``total`` rows,
    ``budgets(skey, budget, n)`` has a row and the number of documents per
    source.  The last documents that still fit are taken; the next is taken as
    well if the sum comes nearer to the budget with it.
    """
    everything = F.lit(1 << HASH_BITS).cast("bigint")
    state = budgets.select("skey", "n", F.col("budget").alias("rest"), F.lit(0).cast("bigint").alias("prefix"))
    for used in range(0, HASH_BITS, STEP_BITS):
        below = HASH_BITS - used - STEP_BITS
        inside = docs
        if used:
            # Only the documents of each source's boundary bucket are summed again.
            at = F.shiftright("h", HASH_BITS - used)
            inside = hot_join(docs, state.select("skey", "n", "prefix"), ["skey"], "n", total).where(at == F.col("prefix"))
        sums = inside.groupBy("skey", F.shiftright("h", below).alias("bucket")).agg(F.sum("size").alias("words"))
        before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        running = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        # The first bucket with which the sum passes the budget is the boundary.
        crossing = running.join(state, "skey").where(F.col("before") + F.col("words") > F.col("rest"))
        cut = crossing.groupBy("skey", "n").agg(F.min(F.struct("bucket", "before", "words", "rest")).alias("c"))
        if not below:
            over, under = F.col("c.before") + F.col("c.words") - F.col("c.rest"), F.col("c.rest") - F.col("c.before")
            cut = cut.select("skey", (F.col("c.bucket") + (over < under).cast("bigint")).alias("cut"))
        else:
            cut = cut.select("skey", (F.col("c.rest") - F.col("c.before")).alias("rest"), F.col("c.bucket").alias("prefix"))
            # Sources without a boundary stay, with a bucket that no document has.
            cut = budgets.select("skey", "n").join(cut, "skey", "left").fillna(-1, "prefix")
        state = write_through(cut, "cuts")
    # A source that never passes its budget is taken whole.
    return budgets.select("skey").join(state, "skey", "left").select("skey", F.coalesce("cut", everything).alias("cut"))


def _source_key() -> Column:
    return F.xxhash64(F.col("source").isNull(), F.col("source").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, skey, size, h`` of every row; a written table, so that texts are read once."""
    return write_through(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            _source_key().alias("skey"),
            n_words(text_of()).cast("bigint").alias("size"),
            draw_of(F.col("doc_id"), text_of()).alias("h"),
        ),
        "sizes",
    )


def plan_of(rows: DataFrame) -> DataFrame:
    """One row per source of ``sized`` rows: ``skey, source_size, target, base, cut, n``.

    Every document is taken ``base`` times, and once more if its number is
    below ``cut``; ``n`` is the number of documents.
    """
    counted = write_through(
        rows.groupBy("source", "skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources"
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    whole = F.col("target") >= F.col("source_size")
    plan = source_targets(counted.select("source", "source_size")).select(
        _source_key().alias("skey"),
        "source_size",
        "target",
        whole.cast("int").alias("base"),
        (F.col("target") - F.when(whole, F.col("source_size")).otherwise(0)).alias("budget"),
    )
    plan = write_through(plan.join(counted.select("skey", "n"), "skey"), "plan")
    cuts = thresholds(rows.select("skey", "h", "size"), plan.select("skey", "budget", "n"), total)
    full = plan.join(cuts, "skey").select("skey", "source_size", "target", "base", "cut", "n")
    return write_through(full, "plan")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows(skey, h, ...)`` with the plan of their source and ``copies``."""
    total = plan.agg(F.sum("n")).first()[0] or 0
    joined = hot_join(rows, plan, ["skey"], "n", total)
    return joined.withColumn("copies", F.col("base") + (F.col("h") < F.col("cut")).cast("int"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for every row.

    ``size`` is the number of words, 0 for a null text; ``taken`` is ``size``
    times ``copies`` (0, 1 or 2).  Documents without a ``doc_id`` draw by their text,
    a null source is a source.  Rows of one source with the same id and text
    draw the same number and share their fate.  Further columns are ignored; an empty
    table gives no rows.
    """
    rows = sized(docs)
    mixed = _with_copies(rows, plan_of(rows))
    taken = (F.col("size") * F.col("copies")).cast("bigint").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns, each repeated as often as it is taken.

    Texts are not shuffled, but for those of sources of very few documents.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    used = docs.select(row, _source_key().alias("skey"), draw_of(F.col("doc_id"), text_of()).alias("h"))
    chosen = _with_copies(used, plan_of(sized(docs))).where(F.col("copies") > 0)
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
