"""Expressions on token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.config import IGNORE_LABEL
from trailframe.functions.let import bind, bind_all


def last_subsequence(ids: Column, pattern: Column) -> Column:
    """Start of the last occurrence of ``pattern``; -1 if there is none.

    An empty pattern is found behind the last id.  The search runs on the ids
    written as text, from the end, which is one native scan instead of a
    comparison per place.
    """
    found = bind_all(_last_place, text=_as_text(ids), mark=_as_text(pattern))
    return F.when(F.size(pattern) == 0, F.size(ids)).otherwise(found).cast("int")


def _as_text(ids: Column) -> Column:
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def _last_place(b: Column) -> Column:
    back = F.position(F.reverse(b["mark"]), F.reverse(b["text"]))
    before = F.substring(b["text"], F.lit(1), F.length(b["text"]) - back + 1 - F.length(b["mark"]))
    commas = F.length(before) - F.length(F.replace(before, F.lit(","), F.lit("")))
    return F.when(back == 0, F.lit(-1)).otherwise(commas)


def last_position(ids: Column, wanted: int) -> Column:
    """0-based position of the last ``wanted``; null if absent."""
    back = F.array_position(F.reverse(ids), F.lit(wanted))
    return F.when(back > 0, F.size(ids) - back).cast("int")


def loss_start(ids: Column, marker: Column, response: Column) -> Column:
    """First position that carries loss.

    Behind the last role marker; else at the last occurrence of the response;
    else at the middle.
    """

    def behind(after_marker: Column) -> Column:
        return F.when(after_marker >= 0, after_marker + F.size(marker))

    def found(at_response: Column) -> Column:
        return F.when(at_response >= 0, at_response)

    # Each search runs once, and the second only where the first finds nothing.
    return F.coalesce(
        bind(last_subsequence(ids, marker), behind),
        bind(last_subsequence(ids, response), found),
        F.floor(F.size(ids) / F.lit(2)),
    ).cast("int")


def mask_labels(ids: Column, start: Column, eos_id: int | None) -> Column:
    """Ids with everything before ``start`` ignored.

    All end-of-sequence ids are ignored too, except the last one, which always
    carries loss.
    """
    ignored = F.lit(IGNORE_LABEL)
    hidden = F.array_repeat(ignored, F.least(start, F.size(ids)))
    shown = F.slice(ids, start + 1, F.size(ids))
    if eos_id is None:
        return F.concat(hidden, shown)
    open_ends = F.transform(shown, lambda t: F.when(t == eos_id, ignored).otherwise(t))

    def with_last_end(b: Column) -> Column:
        head = F.slice(b["labels"], 1, b["last"])
        tail = F.slice(b["labels"], b["last"] + 2, F.size(b["labels"]))
        return F.when(b["last"].isNull(), b["labels"]).otherwise(
            F.concat(head, F.array(F.lit(eos_id)), tail)
        )

    return bind_all(with_last_end, labels=F.concat(hidden, open_ends), last=last_position(ids, eos_id))


def truncate_ids(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def pad_right(values: Column, length: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), (length - F.size(values)).cast("int")))
