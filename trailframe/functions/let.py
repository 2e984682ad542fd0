"""Evaluate an expression once where a lambda needs it for every element.

The optimizer may inline a computed column into the lambda that uses it, and a
lambda body is evaluated per element.  Passing the value through a one-element
array turns it into a lambda variable, which is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def bind_all(body: Callable[[Column], Column], **values: Column) -> Column:
    """The same for several values, passed as one struct."""
    return bind(F.struct(*[v.alias(k) for k, v in values.items()]), body)
